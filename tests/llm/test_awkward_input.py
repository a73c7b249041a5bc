"""Nulls in every column, empty and very long texts, ties, repeated rows, empty tables and clashing names: the stages and operators give defined results."""

import random
from collections import Counter

import pytest

import corpus_pipeline
from octolith.llm import fingerprint, packing, simhash, warc

CLASHES = ["_row", "_k1", "_k", "_h", "drops", "gid", "copies", "rank", "length", "node", "sketch", "block", "head", "lang_pred", "text_hash", "fp"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHES)


def words(rng, n, letters="abcdefgh"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    body = [words(rng, rng.randint(20, 90)) for _ in range(30)]
    texts = [*body, body[0], body[1], "", " \n ", None, "one", words(rng, 30_000), "\n".join(["same line again here"] * 50), "12345 !!"]
    rest = [f"v{k}" for k in range(len(CLASHES))]
    out = [(k, t, "en", ["a", "b", None][k % 3], len(t or ""), *rest) for k, t in enumerate(texts)]
    return [*out, out[3], out[3], (None, body[4], None, None, None, *rest), (7, body[5], "en", "a", 1, *[None] * len(CLASHES)), (None,) * len(out[0])]


def test_stages(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        if name == "pack":
            assert {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns)
            assert sum(r.piece == 0 for r in out.collect()) == len(rows)
            continue
        assert out.columns == docs.columns, name
        got = out.collect()
        kept = Counter((r.doc_id, r.text) for r in got)
        if name == "language":
            assert all(r.text is not None and any(c.isalpha() for c in r.text) for r in got) and kept[3, rows[3][1]] == 3
        elif name == "lines":
            assert kept[None, None] == 1 and kept[3, rows[3][1]] == 3 and kept[35, "one"] == 1
            assert not any(k == 30 for k, _ in kept)  # a copy of the first document has no line left
            assert kept[37, rows[37][1]] == 1  # repeats within one document stay
        elif name == "near_duplicates":
            assert kept[3, rows[3][1]] == 1 and max(kept.values()) == 1 and not {30, 31} & {k for k, _ in kept}
            assert sum(not (t or "").split() for _, t in kept) == 1
        else:
            assert set(kept) <= {(r[0], r[1]) for r in rows}
        assert all(r["_row"] in ("v0", None) for r in got)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "").count() == 0, name


def test_run_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_fingerprint_of_far_ids_and_clashing_names(spark, rows):
    """Ids with huge gaps fall into many blocks; every document still meets the next one."""
    rng = random.Random(4)
    made = [(k * 3, words(rng, 5), "x", "y") for k in range(2000)] + [(10**15 + k, words(rng, 5), "x", "y") for k in range(5)]
    got = {r.doc_id: r for r in fingerprint.fingerprints(spark.createDataFrame(made, "doc_id long, text string, block string, head string").repartition(5)).collect()}
    order = sorted(made, reverse=True)
    assert len(got) == len(made)
    import hashlib

    for (k, t, *_), (_, following, *_) in zip(order, [*order[1:], order[0]], strict=True):
        assert got[k].edited_sha256 == hashlib.sha256(fingerprint.edited(t, following).encode()).hexdigest()
    assert len(fingerprint.fingerprints(spark.createDataFrame(rows, SCHEMA)).collect()) == len(rows)


def test_packing_of_equal_lengths_in_many_blocks(spark, monkeypatch):
    """More pieces of one length than fit one block: ranks and places stay gapless."""
    monkeypatch.setattr(packing, "BLOCKS", 2)
    monkeypatch.setattr(packing, "PER_BLOCK", 10)
    docs = spark.createDataFrame([(k, "a b c") for k in range(300)], "doc_id long, text string")
    got = packing.pack(docs, packing.default_tokenizer(), 16).collect()
    assert len({(r.sequence_id, r.offset) for r in got}) == 300 and len({r.sequence_id for r in got}) == 75


def test_hot_payloads_and_repeated_pages(spark, tmp_path):
    """Many copies of one payload, a repeated row, null ids: one response, the others revisit it."""
    big = "z" * 3000
    pages = [(k, f"http://h/{k}", big) for k in range(200)] + [(199, "http://again/", big), (None, None, big), (None, "u", None)]
    spark.createDataFrame(pages, "page_id long, url string, html string").repartition(4).write.parquet(f"{tmp_path}/pages.parquet")
    got = warc.op9_warc(spark, str(tmp_path)).collect()
    kinds = Counter((r.record_type, r.refers_to) for r in got)
    assert kinds == {("revisit", 199): 200, ("response", None): 3} and all(r.page_id in (199, None) for r in got if r.record_type == "response")


def test_simhash_ids_and_names(spark, rows):
    got = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    zero = [r for r in got if r.fingerprint == "0" * 16]
    assert {r.component_id for r in zero} == {min(r.doc_id for r in zero if r.doc_id is not None)}
