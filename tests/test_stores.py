"""Listing and reading through stores that a URI names."""

import os

from pyarrow import fs

from credsieve.plans.file_scan import run_file_scan
from credsieve.plans.scan import ScanConfig
from credsieve.sources import local_files, stores

BODY = 'first\r\ntoken = "abcd12345"\nthird\n'


def tree(root):
    for name, body in {
        "a.py": BODY,
        "_x/.hid/__init__.py": "1\n2",
        "sp ace/50%#é?.py": "odd",
        "sp ace/b.txt": "no",
        "bad.py": None,
    }.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"\xff\xfe" if body is None else body.encode())
    os.symlink(root, root / "_x" / "loop")
    return str(root)


def corp(root):
    """A store of the scheme corp://, whose top is a folder here."""

    def open_store(uri):
        from urllib.parse import unquote

        below = fs.SubTreeFileSystem(root, fs.LocalFileSystem())
        return below, unquote(uri.removeprefix("corp://"))

    return open_store


NAMES = ["_x/.hid/__init__.py", "a.py", "bad.py", "sp%20ace/50%25%23%C3%A9%3F.py"]


def test_a_file_uri_lists_like_a_mount(spark, tmp_path, monkeypatch):
    root = "file://" + tree(tmp_path)
    found = local_files.list_files(spark, [root, f"{root}/none"], ["py"])
    assert sorted(os.path.relpath(r.path, root) for r in found.collect()) == NAMES
    mounted = local_files.list_files(spark, [str(tmp_path)], ["py"])
    assert sorted(r.length for r in found.collect()) == sorted(r.length for r in mounted.collect())
    assert sorted(r.modified_ms for r in found.collect()) == sorted(r.modified_ms for r in mounted.collect())
    bodies = {os.path.relpath(r.path, root): r for r in local_files.read_bodies(found).collect()}
    assert bodies["a.py"].content == BODY.replace("\r\n", "\n")
    assert bodies[NAMES[3]].content == "odd"
    assert bodies["bad.py"].content is None and bodies["bad.py"].error
    assert {r.content for r in local_files.read_local_code(found).collect()} >= {"", "odd"}


def test_another_scheme_by_its_own_function(spark, tmp_path):
    tree(tmp_path)
    # The tree's link leads out of the store's view of local links; it is not there.
    os.remove(tmp_path / "_x" / "loop")
    opened = corp(str(tmp_path))
    config = ScanConfig(keywords=("token",))
    run = run_file_scan(spark, ["corp://", "corp://none"], ["py"], config, open_store=opened)
    assert [(r.URL, r.Second_Key) for r in run["detections"].collect()] == [("corp://a.py", "token")]
    assert {r.path for r in run["unreadable"].collect()} == {"corp://none", "corp://bad.py"}
    again = run_file_scan(spark, ["corp://"], ["py"], config, run["ledger"], open_store=opened)
    assert again["detections"].isEmpty() and again["ledger"].isEmpty()


def test_unknown_stores_are_reported(spark):
    rows = local_files.walk(spark, ["nowhere://x/y", "file:///not/there"]).collect()
    assert len(rows) == 2 and all(r.error and r.is_root for r in rows)


def test_one_slash_is_a_uri_too(tmp_path):
    (tmp_path / "a.py").write_text("x")
    assert [e[0] for e in stores.folder_entries(f"file:{tmp_path}")] == [f"file:{tmp_path}/a.py"]
    assert stores.Reader().text(f"file:{tmp_path}/a.py") == ("x", None)
