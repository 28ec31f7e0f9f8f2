import json

import pytest

from versoflow.sources import contract as ct
from versoflow.sources import sinks as sk


def doc(page=0, version=2, engine="e", lines=(), **more):
    return json.dumps({"schema_version": version, "engine": engine, "page_index": page, "lines": list(lines), **more})


def test_documents_good_and_bad(spark):
    good = doc(0, lines=[{"text": "a", "box": [-0.1, 0.2, 0.5, 2.0], "confidence": 0.9, "tokens": []}, {"text": "b", "box": [0, 0, 1, 1]}], direction="Vertical-RL ", blocks=[{"type": "Doc_Title", "box": [0, 0, 1, 1], "line_start": 0, "line_end": 1}, {"type": "odd", "box": [0, 0, 1, 1], "line_start": 0, "line_end": 2}])
    rows = [(0, good), (1, doc(2)), (2, doc(2, version=3)), (3, doc(3, engine="other")), (4, '{"schema'), (5, None), (6, doc(6, lines=[{"text": "x", "box": [0, 1]}])), (7, json.dumps({"schema_version": 1, "engine": "e", "page_index": 7}))]
    p = ct.parse_documents(spark.createDataFrame(rows, "page_index int, document string"), "e").cache()
    assert {r.page_index: r.problem for r in p.collect()} == {0: None, 1: "page", 2: "version", 3: "engine", 4: "unreadable", 5: "unreadable", 6: "box", 7: "no lines"}
    ls = {r.line_index: r for r in ct.document_lines(p).collect()}
    assert ls[0].tokens == [] and ls[1].tokens is None and ls[0].direction == "vertical-rl"
    assert ls[0].box == pytest.approx([0.0, 0.2, 0.5, 0.8]) and ls[0].lowest_confidence == 0.9 and ls[1].lowest_confidence is None
    blocks = ct.document_blocks(p)
    assert [r.type for r in blocks.orderBy("block_index").collect()] == ["title", "unknown"]
    assert {r.line_index: r.block_type for r in ct.lines_with_block(ct.document_lines(p), blocks).collect()} == {0: "title", 1: "unknown"}


def test_injected_reader_and_images(spark, tmp_path):
    for n in (1, 2):
        (tmp_path / f"{n:04d}.png").write_bytes(b"p" * n)
    (tmp_path / "note.txt").write_text("x")
    im = ct.page_images(spark, str(tmp_path)).cache()
    assert {(r.page_index, r.length) for r in im.collect()} == {(1, 1), (2, 2)}
    read = ct.read_pages(im, lambda content, page: doc(page, lines=[{"text": f"{len(content)}"}]))
    assert {r.text for r in ct.document_lines(ct.parse_documents(read)).collect()} == {"1", "2"}
    have = spark.createDataFrame([(1,)], "page_index int")
    assert [r.page_index for r in ct.new_pages(im, have).collect()] == [2]
    rec = spark.createDataFrame([(1, "0", 1), (9, "0", 1)], "page_index int, sha256 string, length bigint")
    assert {(r.page_index, r.status) for r in ct.changed_pages(im, rec).collect()} == {(1, "changed"), (2, "unrecorded"), (9, "missing")}


def test_manifest(spark, tmp_path):
    f = tmp_path / "m.json"
    f.write_text(json.dumps({"schema_version": 1, "cases": [{"id": "a", "language": "en"}, {"id": "b", "language": "zh"}]}))
    assert ct.load_manifest(spark, str(f)).count() == 2
    f.write_text(json.dumps({"schema_version": 1, "cases": [{"id": "a"}, {"id": "a"}]}))
    with pytest.raises(ValueError):
        ct.load_manifest(spark, str(f)).count()


def test_synthetic_readers(spark):
    d = spark.createDataFrame([(1, "ab\ncd\n"), (2, None), (3, "")], "page_id int, text string")
    got = {(r.page_id, r.line_index): r.text for r in ct.synthetic_reader(d, (1,)).collect()}
    assert got == {(1, 0): "ab", (1, 1): "cX", (1, 2): "", (3, 0): ""}


def test_sinks(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "id int, v string")
    b = spark.createDataFrame([(2, "z"), (3, "w"), (3, "w")], "id int, v string")
    assert [r.id for r in sk.append_new(b, a, ["id"]).collect()] == [3]
    assert {tuple(r) for r in sk.merge_rows(a, b, ["id"]).collect()} == {(1, "x"), (2, "z"), (3, "w")}
    assert sk.json_lines(spark.createDataFrame([(1, None)], "b int, a string")).first()[0] == '{"a":null,"b":1}'
    assert json.loads(sk.report(a, ["id"], ["v"]).where("id = 1").first()["document"]) == [{"v": "x"}]


def test_book_archive_loses_nothing_and_is_stable():
    chapters = [("One & two", ["a < b", "c"]), ("Three", ["d\ne"])]
    data = sk.book_archive("T", "id", "en", chapters)
    assert data == sk.book_archive("T", "id", "en", chapters)
    assert sk.archive_text(data) == "Oneands".replace("ands", "&two") + "a<bc" + "Three" + "de"
    assert sk.receipt(data, layout="flow")["byte_size"] == len(data)
