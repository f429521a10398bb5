"""The pipeline row by row against the plain versions of its stages."""

import random

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from kodagraf.llm import bpe, quality
from tests.llm import brute

LINE = "This line stands in many of the documents here"


def documents():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = {i: prose(70) for i in range(40)}
    texts |= {100 + i: f"{texts[i]}\n{LINE}\n{prose(12)}" for i in range(4)}  # near copies once the line has gone
    texts |= {200 + i: texts[20] for i in range(5)}
    texts |= {300 + i: f"{prose(40)}\n  {LINE.upper()} " for i in range(3)}
    items = [("b1", prose(30)), ("b2", prose(8)), ("b3", None), ("b4", ""), ("b5", prose(400))]
    texts[400] = f"{prose(50)} {items[0][1]} {prose(50)}"  # contaminated
    texts[401] = f"{prose(60)} {items[1][1]}. {prose(20)}"  # contaminated by a short item
    texts[402] = f"{prose(900)} {items[0][1]} {prose(900)}"  # hit, but in a small part
    texts |= {500: None, 501: "", 502: " \n\t\n", 503: "too short", 504: "same eight words come back again and again " * 12, 505: prose(20_000)}
    return list(texts.items()), items


def plain(docs, items):
    """Stages two to five over the documents that the rules keep."""
    lines = brute.line_dedup(docs)
    docs = [(i, None if t is None else lines[i][2]) for i, t in docs]
    near = {i: (size, least) for i, size, least in brute.near(docs, 5, 80, 100)}
    docs = [(i, t) for i, t in docs if near[i][0] == 0 or near[i][1] == i]
    spoilt = {r[0] for r in brute.contamination(docs, items) if r[-1]}
    tok = Tokenizer.from_file(bpe.default_path())
    out = {}
    for i, t in docs:
        if i not in spoilt:
            ids = tok.encode(t or "", add_special_tokens=False).ids
            text = tok.decode(ids, skip_special_tokens=False)
            out[i] = (len(ids), brute.sha(" ".join(map(str, ids))), brute.sha(text))
    return out


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_equals_its_plain_stages(spark, make_docs, tmp_path, empty):
    rows, items = documents()
    docs = make_docs(rows).limit(0) if empty else make_docs(rows)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path))
    found = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got.collect()}
    kept = {r["doc_id"] for r in quality.report(docs).collect() if r["kept"]}
    assert found == plain([(i, t) for i, t in rows if i in kept], items)
    if not empty:
        assert not kept & {i for i, t in rows if brute.quality(t)[-1]} and {*range(40), 402} <= kept
        assert {400, 401} <= kept and not {400, 401} & set(found) and 402 in found
        assert not {100, 101, 102, 103} & set(found) and {0, 1, 2, 3} <= set(found)  # near copies
        # One line is all of these texts, so line dedup empties all but the last.
        assert found[204][0] > 0 and {found[i][0] for i in (20, 200, 201, 202, 203)} == {0}
