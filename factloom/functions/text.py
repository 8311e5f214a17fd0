"""Scalar functions over columns: tokens, paths, names, hashes, distances and costs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters per token, prompt and output reserve, safety margin.
CHARS_PER_TOKEN, PROMPT_OVERHEAD, OUTPUT_RESERVE, MARGIN = 4, 3000, 4096, 0.9
#: Share of the input price that a token read from or written to the cache costs.
CACHE_READ, CACHE_WRITE = 0.1, 1.25


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def utf16_length(text) -> Column:
    """Length in UTF-16 code units: characters beyond the basic plane count as two."""
    return (F.octet_length(F.encode(col(text), "UTF-16BE")) / 2).cast("int")


def estimate_tokens(text) -> Column:
    """a quarter of the UTF-16 length, rounded up; null counts as empty."""
    return F.ceil(F.coalesce(utf16_length(text), F.lit(0)) / CHARS_PER_TOKEN)


def token_budget(max_tokens) -> Column:
    """what is left for file contents in a context of max_tokens."""
    return F.floor((col(max_tokens) - PROMPT_OVERHEAD - OUTPUT_RESERVE) * F.lit(MARGIN))


def human_size(n) -> Column:
    """F3."""
    n = col(n)
    kb, mb = n / 1024.0, n / 1048576.0
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1048576, F.format_string("%.1f KB", kb)).otherwise(F.format_string("%.1f MB", mb))


def tenths(n, unit: int) -> Column:
    """n / unit with one decimal, as the nearest double rounds: a tie of decimals goes where that double lies, an exact one up.
    Which side it lies on is the sign of its error, from a product of its two halves that is exact."""
    n = col(n)
    x, half = n / F.lit(float(unit)), F.lit(134217729.0)  # 2^27 + 1 splits a double
    high = x * half - (x * half - x)
    error = (high * unit - n) + (x - high) * unit
    rest, step = n % (unit // 10), unit // 10
    up = (rest * 2 > step) | (rest * 2 == step) & (error >= 0)
    k = F.floor(n / step) + up.cast("long")
    return F.concat(F.floor(k / 10).cast("string"), F.lit("."), (k % 10).cast("string"))


def short_count(n) -> Column:
    """tokens with K and M, one decimal unless it is 0."""
    n = col(n)
    part = lambda unit, mark: F.concat(F.when(n % unit == 0, F.format_string("%d", F.floor(n / unit))).otherwise(tenths(n, unit)), F.lit(f"{mark} tokens"))
    return F.when(n >= 1_000_000, part(1_000_000, "M")).when(n >= 1_000, part(1_000, "K")).otherwise(F.concat(n.cast("string"), F.lit(" tokens")))


def money(dollars) -> Column:
    """F4."""
    return F.format_string("$%.2f", col(dollars).cast("double"))


def duration(ms) -> Column:
    """whole seconds, with minutes from one minute on."""
    s = F.floor(col(ms) / 1000)
    return F.when(s < 60, F.format_string("%ds", s)).otherwise(F.format_string("%dm %ds", F.floor(s / 60), s % 60))


def bar(part, whole, width: int = 20, plain: bool = False) -> Column:
    """a bar of filled and empty cells; plain: without box characters."""
    full, empty = ("=", "-") if plain else ("━", "─")
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), col(part) / F.greatest(col(whole), F.lit(1))))
    n = F.floor(share * width + 0.5).cast("int")
    return F.concat(F.repeat(F.lit(full), n), F.repeat(F.lit(empty), F.lit(width) - n))


def truncate(text, n: int) -> Column:
    """at most n characters, the last three as dots if some were cut."""
    return F.when(F.length(col(text)) > n, F.concat(F.substring(col(text), 1, n - 3), F.lit("..."))).otherwise(col(text))


def anchor(text) -> Column:
    """heading to link target."""
    return F.regexp_replace(F.regexp_replace(F.lower(col(text)), r"[^a-z0-9 -]", ""), r" +", "-")


def resolve_path(base, relative) -> Column:
    """a relative specifier against the folder of base; null if it is not relative."""
    parts = F.concat(F.split(dirname(base), "/"), F.split(col(relative), "/"))
    step = lambda acc, x: F.when(x.isin("", "."), acc).when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x)))
    return F.when(F.startswith(col(relative), F.lit(".")), F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/"))


def strip_extension(path) -> Column:
    """F8."""
    return F.regexp_replace(col(path), r"\.[^./]+$", "")


def dirname(path) -> Column:
    """empty for a file at the root."""
    return F.when(F.contains(col(path), F.lit("/")), F.regexp_replace(col(path), r"/[^/]*$", "")).otherwise(F.lit(""))


def basename(path) -> Column:
    """F9."""
    return F.substring_index(col(path), "/", -1)


def extname(path) -> Column:
    """with its dot; empty for names without one and for dotfiles."""
    return F.regexp_extract(basename(path), r"^.+(\.[^.]*)$", 1)


def top_dir(path) -> Column:
    """F10."""
    return F.split(col(path), "/")[0]


def line_count(text) -> Column:
    """line feeds plus one."""
    return F.size(F.split(col(text), "\n"))


def content_hash(text) -> Column:
    """F15."""
    return F.sha2(col(text), 256)


def json_text(value) -> Column:
    """A struct as JSON whose control characters are written in lower case, as JSON.stringify does."""
    plain = out = F.to_json(value)
    for c in (0x0B, 0x0E, 0x0F, *range(0x1A, 0x20)):  # those whose codes have a letter
        out = F.regexp_replace(out, rf"(?<!\\)((?:\\\\)*)\\u00{c:02X}", rf"$1\\u00{c:02x}")
    return F.when(F.rlike(plain, F.lit(r"\\u00[01][A-F]")), out).otherwise(plain)


def document_fingerprint(source, content) -> Column:
    """F16: stable hash of a document and where it comes from."""
    return F.sha2(json_text(F.struct(col(source).alias("sourceFile"), col(content).alias("content"))), 256)


def round_key(number, model, fingerprint, prior) -> Column:
    """changes with the model, the files and every earlier round's result."""
    return F.sha2(json_text(F.struct(col(number).alias("roundNumber"), col(model).alias("model"), col(fingerprint).alias("analysisFingerprint"), col(prior).alias("priorRoundHashes"))), 256)


def relevance(distance) -> Column:
    """0 to 100."""
    return F.round(100 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - col(distance) / 2)), 2)


def l2_distance(a, b) -> Column:
    """in double precision."""
    return F.sqrt(F.aggregate(F.zip_with(col(a), col(b), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def strip_frontmatter(text) -> Column:
    """F23."""
    return F.regexp_replace(col(text), r"^---\n(?s:.*?)\n---\n+", "")


def section_path(h1, h2, h3) -> Column:
    """F24."""
    return F.coalesce(F.nullif(F.concat_ws(" > ", *(F.nullif(col(h), F.lit("")) for h in (h1, h2, h3))), F.lit("")), F.lit("Root"))


def unicode_trim(text) -> Column:
    return F.regexp_replace(col(text), r"(?U)^\s+|\s+$", "")


def preview(text, n: int = 200) -> Column:
    """F25."""
    return unicode_trim(F.substring(col(text), 1, n))


def one_line(text) -> Column:
    """F26."""
    return unicode_trim(F.regexp_replace(col(text), r"(?U)\s+", " "))


def canonical_target(name) -> Column:
    """F27."""
    return F.regexp_replace(F.lower(unicode_trim(name)), r"[\s_]+", "-")


def diagram_id(name) -> Column:
    """F28."""
    s = F.regexp_replace(col(name), r"[^A-Za-z0-9_]", "_")
    return F.when(F.rlike(s, F.lit(r"^\d")), F.concat(F.lit("n_"), s)).otherwise(s)


def table_cell(text) -> Column:
    """backslashes, then bars, escaped for a markdown table."""
    return F.replace(F.replace(col(text), F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))


def code_ref(path, line=None) -> Column:
    """a path, without what leads to the root, and a line as code."""
    bare = F.regexp_replace(col(path), r"^\.?/", "")
    return F.concat(F.lit("`"), bare, F.lit("`")) if line is None else F.concat(F.lit("`"), bare, F.lit(":L"), col(line).cast("string"), F.lit("`"))


def cross_ref(doc, anchor_of=None, label=None) -> Column:
    """a link to a document, shown by its name unless a label is given."""
    words = F.regexp_replace(F.regexp_replace(col(doc), r"^\d+-", ""), "-", " ")
    shown = col(label) if label is not None else F.array_join(F.transform(F.split(words, " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))), " ")
    return F.concat(F.lit("["), shown, F.lit("]("), col(doc), F.lit(".md"), F.concat(F.lit("#"), col(anchor_of)) if anchor_of is not None else F.lit(""), F.lit(")"))


def table_row(cells: list) -> Column:
    """a row of a markdown table."""
    return F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(table_cell(c), F.lit("")) for c in cells)), F.lit(" |"))


def rewrite_md_links(html) -> Column:
    """href to a local .md page leads to its .html."""
    return F.regexp_replace(col(html), r'href="(?![a-zA-Z][a-zA-Z0-9+.-]*://)([^"]+)\.md(#[^"]*)?"', r'href="$1.html$2"')


def escape_html(text) -> Column:
    """F30."""
    out = col(text)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def import_class(source) -> Column:
    """F31, P21."""
    return F.when(F.startswith(col(source), F.lit(".")), "relative").when(F.startswith(col(source), F.lit("@")), "scoped-package").otherwise("package")


#: What counts as a reference to code.
REFERENCE = r"(?:src/|\.ts\b|\.js\b|\.py\b|\.rs\b|\.go\b|function\s+\w+|class\s+\w+)"


def references(text) -> Column:
    """references to code in a text."""
    return F.regexp_count(col(text), F.lit(REFERENCE))


def specificity(text) -> Column:
    """references per hundred characters."""
    return references(text) / F.greatest(utf16_length(text) / 100, F.lit(1.0))


#: White space, what may stand before a path that a text names, and what paths look like.
WIDE_SPACE = r"\s\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
PATH_CLAIM = rf"(?:^|[{WIDE_SPACE}\"',\[(])([a-zA-Z0-9_./-]+\.(?:ts|js|tsx|jsx|py|rs|go|json|yml|yaml|toml|md|css|html|sh|Dockerfile))(?![a-zA-Z0-9_])"


def path_claims(text) -> Column:
    """Distinct paths with a folder that a text names, in order."""
    found = F.regexp_extract_all(col(text), F.lit(PATH_CLAIM), F.lit(1))
    return F.array_distinct(F.filter(found, lambda x: F.contains(x, F.lit("/"))))


def encode_cursor(offset) -> Column:
    """base64url of {"offset":n} without padding."""
    return F.rtrim(F.translate(F.base64(F.encode(F.concat(F.lit('{"offset":'), col(offset).cast("string"), F.lit("}")), "UTF-8")), "+/=", "-_ "))


def decode_cursor(cursor) -> Column:
    """null for malformed cursors and negative offsets."""
    raw = F.translate(col(cursor), "-_", "+/")
    text = F.try_to_binary(F.rpad(raw, (F.ceil(F.length(raw) / 4) * 4).cast("int"), F.lit("=")), F.lit("base64")).cast("string")
    n = F.get_json_object(text, "$.offset").try_cast("long")
    return F.when(n >= 0, n)


def complexity(files) -> Column:
    """F38."""
    return F.when(col(files) < 50, "small").when(col(files) < 200, "medium").otherwise("large")


def backoff(base_ms, attempt, jitter) -> Column:
    """jitter in [0, 1)."""
    return col(base_ms) * F.pow(F.lit(2), col(attempt)) * (0.5 + col(jitter))


def round_cost(inp, out, read, written, price_in, price_out) -> Column:
    """prices per million tokens."""
    return (col(inp) * col(price_in) + col(out) * col(price_out) + col(read) * col(price_in) * CACHE_READ + col(written) * col(price_in) * CACHE_WRITE) / 1e6


def cache_saving(read, price_in) -> Column:
    """null if nothing was read from the cache."""
    return F.when(col(read) > 0, col(read) * col(price_in) * (1 - CACHE_READ) / 1e6)


def cache_share(inp, read, written) -> Column:
    """percent of the input that came from the cache; null if nothing was read from it."""
    return F.when(col(read) > 0, 100 * col(read) / (col(inp) + col(read) + col(written)))


def six_months_before(now) -> Column:
    """the date half a year earlier by the calendar."""
    return F.add_months(col(now).cast("date"), -6)


def expires(at, ttl_ms: int) -> Column:
    """F39."""
    return col(at) + F.make_dt_interval(secs=F.lit(ttl_ms / 1000))


#: Marker to category.
TODO_CATEGORY = {"FIXME": "bugs", "HACK": "bugs", "XXX": "bugs", "TODO": "tasks", "NOTE": "notes", "WARN": "notes", "DEPRECATED": "debt", "TEMP": "debt", "OPTIMIZE": "optimization", "REVIEW": "optimization"}
TODO = rf"(?i)\b({'|'.join(TODO_CATEGORY)})(?::\s*|\s+)(.*)"


def todo_marker(line) -> Column:
    """the first marker of a line, in capitals; null if there is none."""
    return F.nullif(F.upper(F.regexp_extract(col(line), TODO, 1)), F.lit(""))


def todo_category(marker) -> Column:
    out = F.lit(None).cast("string")
    for category in sorted(set(TODO_CATEGORY.values())):
        out = F.when(col(marker).isin(*[m for m, c in TODO_CATEGORY.items() if c == category]), category).otherwise(out)
    return out


def todo_text(line) -> Column:
    return F.trim(F.regexp_extract(col(line), TODO, 2))


def issue_refs(line) -> Column:
    """#12 and AB-12 anywhere in a line."""
    return F.regexp_extract_all(col(line), F.lit(r"(#\d+|[A-Z]{2,}-\d+)"), F.lit(1))


#: How languages read a variable of the environment.
ENV_REFS = (r"process\.env\.([A-Z_][A-Z0-9_]*)", r"os\.environ\[['\"]([A-Z_][A-Z0-9_]*)['\"]\]", r"os\.getenv\(['\"]([A-Z_][A-Z0-9_]*)['\"]\)", r"env::var\(['\"]([A-Z_][A-Z0-9_]*)['\"]\)", r"os\.Getenv\(['\"]([A-Z_][A-Z0-9_]*)['\"]\)")


def env_refs(line) -> Column:
    """names in the order of their places in the line; one pattern of all alternatives finds them, a second takes the name."""
    whole = "|".join(p.replace("([A-Z", "(?:[A-Z") for p in ENV_REFS)
    return F.transform(F.regexp_extract_all(col(line), F.lit(f"({whole})"), F.lit(1)), lambda m: F.regexp_extract(m, r"(?:env\.|['\"])([A-Z_][A-Z0-9_]*)", 1))


def env_file_var(line) -> Column:
    """S13."""
    return F.nullif(F.regexp_extract(unicode_trim(line), r"^([A-Z_][A-Z0-9_]*)=", 1), F.lit(""))


#: What counts as a test, by framework.
TEST_PATTERNS = {
    "vitest": (r"\b(?:it|test|describe)\s*\(",), "jest": (r"\b(?:it|test|describe)\s*\(",), "mocha": (r"\b(?:it|describe)\s*\(",), "pytest": (r"\bdef\s+test_",), "go_test": (r"\bfunc\s+Test[A-Z]",), "rust_test": (r"#\[test\]", r"#\[cfg\(test\)\]"),
}


def count_tests(content, framework: str) -> Column:
    """F13."""
    return sum((F.regexp_count(col(content), F.lit(p)) for p in TEST_PATTERNS[framework]), F.lit(0))


def suggest(value, known: list[str], edits: int = 4, most: int = 3) -> Column:
    """up to `most` known names, in list order: those within `edits`, or if there are none those that contain value."""
    names = F.array(*map(F.lit, known))
    near = F.filter(names, lambda n: F.levenshtein(n, col(value)) <= edits)
    within = F.filter(names, lambda n: F.contains(n, col(value)))
    return F.slice(F.when(F.size(near) > 0, near).otherwise(within), 1, most)
