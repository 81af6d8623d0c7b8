import numpy as np

from lakeloom.llm import cdc, queries


def words(rng, n):
    return " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 9))) for _ in range(n))


def removed(spark, texts, **kw):
    table = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    return {r["doc_id"]: r for r in cdc.remove_repeats(table, **kw).collect()}


def test_short_passages_go_whole(spark):
    rng, texts, left = np.random.default_rng(81), {}, {}
    for k in range(300):
        passage = words(rng, 51) if k % 2 else words(rng, 60)[: cdc.LEAST_RUN]
        before, after = words(rng, 20), words(rng, 20)
        texts[k] = f"{words(rng, 20)} 1 {passage} 2 {words(rng, 20)}"
        texts[1000 + k] = f"{before} 3 {passage} 4 {after}"
        left[1000 + k] = f"{before} 3", f"4 {after}"
    out = removed(spark, texts)
    assert all(out[i]["text"] == texts[i] for i in range(300))
    for i, (a, b) in left.items():
        assert out[i]["text"].split() == f"{a} {b}".split() and out[i]["_first_ids"] == [i - 1000]


def test_matches_beyond_a_piece(spark):
    rng = np.random.default_rng(82)
    body = words(rng, 6000)
    out = removed(spark, {1: f"{words(rng, 9)} 1 {body} 2", 2: f"3 {body} 4", 3: "la " * 3000, 4: "la " * 2000 + "end"})
    assert out[2]["text"].split() == ["3", "4"] and len(out[2]["_spans"]) == 1
    assert out[4]["text"].strip() == "end"


def test_one_document_holds_the_match(spark):
    rng, texts, parts = np.random.default_rng(83), {}, []
    for i in range(200):
        texts[i] = words(rng, 300)
        data = texts[i].encode()
        ends = cdc.cuts(data).tolist()
        parts += [data[a:b].decode() for a, b in zip(ends, ends[1:], strict=False) if 30 <= b - a <= 60][:1]
    texts[1000] = "".join(parts)  # of whole chunks, each in another document
    out = removed(spark, texts)
    assert len(parts) > 100 and out[1000]["text"] == texts[1000] and not out[1000]["_first_ids"]


def test_unspaced_text_beside_a_match_stays(spark):
    rng = np.random.default_rng(87)
    w = lambda n: "".join(chr(0x4E00 + c) for c in rng.integers(0, 20000, n))
    body, code = w(40), "".join(chr(97 + c) for c in rng.integers(0, 26, 150))
    texts = {1: w(200) + body + w(200), 2: "x" * 9 + code + "y" * 9}
    a, b = w(200), w(200)
    texts |= {3: a + body + b, 4: "0123456789" * 30 + code + "9876543210" * 30}
    out = removed(spark, texts)
    assert out[3]["text"] == a + b and out[4]["text"] == "0123456789" * 30 + "9876543210" * 30


def test_a_row_for_each_document(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in queries.table(spark, sf_dir, "documents").collect()}
    out = {r["doc_id"]: r for r in queries.op8_substring_repeats(spark, sf_dir).collect()}
    assert set(out) == set(docs) and 0 < sum(r["n_removed"] > 0 for r in out.values()) < len(docs)
    assert all(r["text"] == docs[i] for i, r in out.items() if not r["n_removed"])
