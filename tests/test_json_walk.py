import copy
import hashlib
import json
import random

from pyspark.sql import functions as F

from tallyframe.functions import json_walk as J


def page(n, blocks=2):
    return {
        "page_number": n, "width": 595.2, "height": 842, "rotation": 0, "status": "extracted", "image_block_count": 0, "limitation": None,
        "blocks": [{"block_index": i, "text": f"t{i}", "bbox": {"x0": 1, "y0": 2.5, "x1": 1e2, "y1": -4}} for i in range(blocks)],
    }


GOOD = {
    "document_id": "d", "source_sha256": "ab" * 32, "source_filename": "f.pdf", "page_count": 2, "coordinate_system": "c", "coordinate_unit": "u", "coordinate_note": "n", "ocr_applied": False,
    "extractor": "e", "extractor_version": "1", "pages": [page(1), page(2, 0)],
}


def broken(path, value="del"):
    doc = copy.deepcopy(GOOD)
    at = doc
    for p in path[:-1]:
        at = at[p]
    if value == "del":
        del at[path[-1]]
    else:
        at[path[-1]] = value
    return json.dumps(doc)


def faults(spark, texts, shape):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r[0] for r in df.orderBy("i").select(J.first_fault(F.col("t"), shape)).collect()]


def test_parsed_report(spark):
    block = ("pages", 0, "blocks", 1)
    cases = {
        json.dumps(GOOD): None,
        "{": "invalid",
        "": "invalid",
        '{"a": 1, "a": 2}': "invalid",
        "[]": ": type",
        "null": ": type",
        broken(("extractor",)): "extractor: missing",
        broken(("pages",)): "pages: missing",
        broken(("pages",), "x"): "pages: type",
        broken(("pages",), {}): "pages: type",
        broken(("pages", 1), []): "pages[1]: type",
        broken(("pages", 1), None): "pages[1]: type",
        broken(("pages", 0, "status"), "other"): "pages[0].status: value",
        broken(("pages", 0, "status")): "pages[0].status: missing",
        broken(("pages", 0, "blocks")): "pages[0].blocks: missing",
        broken(("pages", 0, "limitation"), 1): "pages[0].limitation: type",
        broken(("pages", 0, "limitation"), ""): None,
        broken(("pages", 0, "page_number"), 0): "pages[0].page_number: value",
        broken(("pages", 0, "page_number"), 1.0): "pages[0].page_number: type",
        broken(("pages", 0, "page_number"), True): "pages[0].page_number: type",
        broken(("pages", 0, "page_number"), 10**25): None,
        broken(("pages", 0, "rotation"), -90): "pages[0].rotation: value",
        broken(("pages", 0, "width"), "5"): "pages[0].width: type",
        broken(("pages", 0, "width"), True): "pages[0].width: type",
        broken(block): None,
        broken(block, 7): "pages[0].blocks[1]: type",
        broken((*block, "bbox")): "pages[0].blocks[1].bbox: missing",
        broken((*block, "bbox"), []): "pages[0].blocks[1].bbox: type",
        broken((*block, "bbox", "y1"), None): "pages[0].blocks[1].bbox.y1: type",
        broken((*block, "text"), ""): "pages[0].blocks[1].text: value",
        broken((*block, "block_index"), "1"): "pages[0].blocks[1].block_index: type",
        broken(("page_count",), 3): "page_count: value",
        broken(("page_count",), "2"): "page_count: type",
        broken(("page_count",), 2.0): "page_count: type",
        broken(("ocr_applied",), 0): "ocr_applied: type",
        broken(("source_sha256",), "AB" * 32): "source_sha256: value",
        broken(("document_id",), ""): "document_id: value",
        broken(("more",), {"deep": []}): None,
        None: "invalid",
    }
    assert faults(spark, list(cases), J.PARSED_REPORT) == list(cases.values())
    # the first fault in the order of reading, not of the text
    two = json.loads(broken(("pages", 0, "blocks", 0, "text"), ""))
    two["pages"][0]["rotation"], two["document_id"] = "x", ""
    two["pages"][1]["status"] = ""
    assert faults(spark, [json.dumps(two)], J.PARSED_REPORT) == ["pages[0].rotation: type"]


def test_surplus_and_optional_keys(spark):
    shape = J.Object((("a", J.Object((("b", J.List(J.Whole(None))),), exact=True)), ("c", J.Number(optional=True))), exact=True)
    cases = {
        '{"a": {"b": [1, -2]}}': None,
        '{"a": {"b": [1, -2]}, "c": null}': None,
        '{"a": {"b": []}, "c": 1.5, "z": 1, "d": 1}': "d: surplus",
        '{"a": {"b": [], "x": 1}, "z": 1}': "a.x: surplus",
        '{"a": {"b": [1, "2", null]}}': "a.b[1]: type",
        '{"a": {"b": [1, null]}}': "a.b[1]: type",
        '{"c": "1"}': "a: missing",
    }
    assert faults(spark, list(cases), shape) == list(cases.values())


def shuffled(rng, v):
    if isinstance(v, dict):
        keys = list(v)
        rng.shuffle(keys)
        return {k: shuffled(rng, v[k]) for k in keys}
    return [shuffled(rng, x) for x in v] if isinstance(v, list) else v


def test_canonical_text(spark):
    rng = random.Random(5)

    def some(depth):
        kind = rng.randrange(8 if depth else 5)
        if kind >= 5:
            return {rng.choice(("a", "b", "B", "é", "中", "a b", "_", "10", "9")) + "x" * rng.randrange(2): some(depth - 1) for _ in range(rng.randrange(5))} if kind > 5 else [some(depth - 1) for _ in range(rng.randrange(4))]
        return [None, True, rng.randrange(-9, 10**12), 'q"\\\n\té', round(rng.random(), 3) + 0.0005][kind]

    docs = [some(4) for _ in range(200)]
    rows = [(i, json.dumps(shuffled(rng, d), ensure_ascii=bool(i % 2), indent=i % 3 or None)) for i, d in enumerate(docs)]
    got = {r["i"]: (r["c"], r["h"]) for r in spark.createDataFrame(rows, "i int, t string").select("i", J.canonical(F.col("t")).alias("c"), J.content_hash(F.col("t")).alias("h")).collect()}
    for i, d in enumerate(docs):
        want = json.dumps(d, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
        assert got[i] == (want, hashlib.sha256(want.encode()).hexdigest())
    bad = spark.createDataFrame([("{",), ('{"a":1,"a":1}',), (None,)], "t string").select(J.canonical(F.col("t")), J.content_hash(F.col("t"))).collect()
    assert all(r[0] is None and r[1] is None for r in bad)


def test_a_text_is_parsed_once(spark):
    df = spark.createDataFrame([("{}",)], "t string").select(J.first_fault(F.col("t"), J.PARSED_REPORT).alias("f"))
    assert df._jdf.queryExecution().optimizedPlan().toString().lower().count("parsejson") == 1 and df.first()["f"] == "document_id: missing"
