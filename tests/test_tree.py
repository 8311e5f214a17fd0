"""Discovery that does not enter ignored folders and opens no file that it does not return."""

import os

from factloom.sources import files, tree

PLACED = {
    "a.py": "x", "b.PNG": "", "node_modules/m/i.js": "no", ".hidden/x.py": "no", "src/Z.ts": "z", "src/a.ts": "é", "src/gen/out.ts": "no", "src/gen2/keep.ts": "k", "logs/x.log": "no", "logs/y.txt": "t",
    "pkg/.gitignore": "*.tmp\n!important.log\nlocal/\n", "pkg/x.tmp": "no", "pkg/important.log": "i", "pkg/deep/local/f.py": "no", "pkg/deep/f.py": "f", "x.tmp": "t", "foo/a.md": "no", "foo/keep.md": "kept", "docs/one.md": "m",
    ".gitignore": "*.log\n/src/gen/\nfoo/*\n!foo/keep.md\n",
}
WANT = ["a.py", "docs/one.md", "foo/keep.md", "logs/y.txt", "pkg/deep/f.py", "pkg/important.log", "src/a.ts", "src/gen2/keep.ts", "src/Z.ts", "x.tmp"]


def plant(root):
    for p, text in PLACED.items():
        os.makedirs(os.path.dirname(f"{root}/{p}"), exist_ok=True)
        with open(f"{root}/{p}", "w") as f:
            f.write(text)
    with open(f"{root}/docs/huge.txt", "wb") as f:
        f.write(b"x" * (tree.MAX_BYTES + 1))
    os.symlink(f"{root}/node_modules", f"{root}/link")


class Counting(tree.Local):
    def __init__(self, root):
        super().__init__(root)
        self.listed, self.opened = [], []

    def entries(self, path):
        self.listed.append(path)
        return super().entries(path)

    def read(self, path):
        self.opened.append(path)
        return super().read(path)


def test_only_what_is_wanted_is_opened(tmp_path, monkeypatch):
    root = str(tmp_path)
    plant(root)
    for shared in (1, 3, 64):  # few or many folders are the planner's
        monkeypatch.setattr(tree, "SHARED", shared)
        seen = Counting(root)
        monkeypatch.setattr(tree, "store", lambda _, seen=seen: seen)
        reader = tree.TreeReader({"path": root})
        shares = reader.partitions()
        assert [p for p in seen.opened if not p.endswith(".gitignore")] == []
        rows = [r for s in shares for b in reader.read(s) for r in b.to_pylist()]
        assert sorted(r["path"] for r in rows) == sorted([*WANT, "docs/huge.txt"])
        assert sorted(p for p in seen.opened if not p.endswith(".gitignore")) == sorted(WANT)
        assert not any(p.startswith(("node_modules", ".hidden", "src/gen/", "pkg/deep/local", "link")) for p in seen.listed)
        assert [r["path"] for r in rows if r["warning"]] == ["docs/huge.txt"]


def test_discovered_table(spark, tmp_path):
    root = str(tmp_path)
    plant(root)
    got = files.discover(spark, root).collect()
    assert [r["path"] for r in got] == WANT
    assert {r["path"]: r["content"] for r in got}["src/a.ts"] == "é"
    assert [r["path"] for r in files.discover(spark, f"file://{root}/", ["**/*.ts", "docs/**"], contents=False).collect()] == [p for p in WANT if not p.endswith(".ts") and not p.startswith("docs")]
    assert tree.scan(spark, root).filter("warning is not null").select("path").first()[0] == "docs/huge.txt"
    (tmp_path / "empty").mkdir()
    assert files.discover(spark, f"{root}/empty").count() == 0
