import os

from foliant.sources import files, previews


def shown(data, most):
    text = data[:most].decode("utf-8", errors="replace")
    return text + f"\n\n— Preview truncated at {most} bytes —\n" if len(data) > most else text


def test_files_of_all_sizes(spark, tmp_path):
    made = {
        "a.md": b"# title\n", "empty.json": b"", "wrong.md": b"ok \xff\xfe\xc3( \xe2\x82 end", "cut.json": "é".encode() * 40,
        "edge.md": b"x" * 60, "over.md": b"x" * 61, "plain.bin": b"not shown", "B.MARKDOWN": b"\xf0\x9f\x98\x80",
    }
    for name, data in made.items():
        (tmp_path / name).write_bytes(data)
    (tmp_path / "folder.md").mkdir()
    os.symlink("gone", tmp_path / "link.md")
    got = {os.path.basename(r.path): r for r in previews.previews(files.scan(spark, str(tmp_path)), 60, 50).collect()}
    assert set(got) == set(made) - {"plain.bin"} | {"link.md"}
    assert got["link.md"].text is None and not got["link.md"].highlighted
    for name, r in got.items():
        if name != "link.md":
            assert r.text == shown(made[name], 60), name
            assert r.highlighted == (len(made[name]) <= 50), name
    assert got["a.md"].format == "markdown" and got["empty.json"].format == "json"


def test_no_more_is_read_than_is_shown(spark, tmp_path):
    """A file of 3 GB, of which nearly all is a hole, beside one of over 20 MiB."""
    with open(tmp_path / "huge.md", "wb") as f:
        f.write(b"head " * 5_000_000)
        f.truncate(3 << 30)
    with open(tmp_path / "large.json", "wb") as f:
        f.write(b"y" * (previews.SHOWN + 1))
    with open(tmp_path / "most.json", "wb") as f:
        f.write(b"z" * previews.SHOWN)
    rows = spark.createDataFrame([(f"{tmp_path}/{n}", 1) for n in ("huge.md", "large.json", "most.json")] + [(None, 2), (f"{tmp_path}", 3)], "path string, content int")
    got = previews.with_content(rows, "path").selectExpr("path", "length(content) as n").collect()
    assert [r.n for r in got] == [previews.SHOWN + 1, previews.SHOWN + 1, previews.SHOWN, None, None]
    texts = {os.path.basename(r.path): r for r in previews.previews(files.scan(spark, str(tmp_path))).selectExpr("path", "right(text, 40) as end", "length(text) as n", "highlighted").collect()}
    assert "truncated at 20971520 bytes" in texts["huge.md"].end and "truncated" in texts["large.json"].end and texts["most.json"].n == previews.SHOWN
    assert not any(r.highlighted for r in texts.values())
    assert len(previews.first_bytes(str(tmp_path / "huge.md"), 10)) == 10
