import re
from collections import Counter, defaultdict

import corpus_pipeline as p
from lakeloom.llm import cdc, runtime

EN = "The committee agreed that the old bridge over the river should be repaired before the winter storms arrive again"
DE = "Ein ganz anderer Satz über Straßen, Flüsse und das schöne Wetter heute in den Bergen und an der kalten See"


def kept(spark, stage, table):
    docs = spark.createDataFrame(table, "doc_id long, text string, lang string")
    return sorted(((r["doc_id"], r["text"]) for r in stage(spark, docs, None).collect()), key=repr)


def test_language_decides_by_row(spark):
    table = [(1, EN, "en"), (1, None, "en"), (1, "12 !", "en"), (2, DE, "de"), (None, "3 ?", None), (None, DE, "de"), (3, "", "en")]
    assert kept(spark, p.language, table) == [(1, EN), (2, DE), (None, DE)]


def test_near_duplicates_decide_by_row(spark):
    table = [(1, EN, "en"), (2, EN, "en"), (2, DE, "de"), (2, DE, "de"), (None, DE, "de"), (None, "a row of its own", "en"), (3, "", "en")]
    assert kept(spark, p.near_duplicates, table) == [(1, EN), (2, DE), (3, ""), (None, "a row of its own")]
    assert kept(spark, p.near_duplicates, [(5, EN, "en"), (4, EN, "en"), (6, DE, "de")]) == [(4, EN), (6, DE)]


def shingles(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_stages_equal_brute_force(spark, sf_dir):
    """Each stage on all that the one before it kept."""
    rows = {}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in [("documents", lambda s, d, f: d), *p.STAGES]:
        docs = runtime.materialize(stage(spark, docs, sf_dir), name)
        rows[name] = docs.collect()
    texts = {name: {r["doc_id"]: r["text"] for r in rows[name]} for name in ("documents", "language", "near_duplicates", "repeats")}
    assert texts["language"] == {i: t for i, t in texts["documents"].items() if t and any(c.isalpha() for c in t)}

    sets = {i: shingles(t) for i, t in texts["language"].items()}
    where, part = defaultdict(list), {i: i for i in sets}
    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    near = {(a, b) for found in where.values() for a in found for b in found if a < b}
    near = {(a, b) for a, b in near if 100 * (k := len(sets[a] & sets[b])) >= 80 * (len(sets[a]) + len(sets[b]) - k)}
    changed = True
    while changed:
        changed = False
        for a, b in near:
            if part[a] != part[b]:
                part[a] = part[b] = min(part[a], part[b])
                changed = True
    assert texts["near_duplicates"] == {i: t for i, t in texts["language"].items() if part[i] == i}

    seen, least = set(), cdc.LEAST_RUN
    for i, t in sorted(texts["near_duplicates"].items()):  # what went stands in an earlier document, and little that does is left
        data, left = t.encode(), texts["repeats"][i].encode()
        earlier = [data[k : k + least] in seen for k in range(max(0, len(data) - least + 1))]
        if not any(earlier):
            assert left == data
        assert len(left) >= len(data) - sum(earlier) - least * (1 + sum(a != b for a, b in zip(earlier, earlier[1:], strict=False)))
        seen |= {data[k : k + least] for k in range(max(0, len(data) - least + 1))}

    words = lambda rs: Counter({s: sum(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in rs if r["source"] == s) for s in {r["source"] for r in rs}})
    before, after = words(rows["repeats"]), words(rows["mix"])
    for k, s in enumerate(sorted(before, key=lambda s: (s is None, s or ""))):
        assert after[s] <= 3 * before[s]
        if after[s] < 3 * before[s] - 1:  # not at its most: the common level by its weight
            level = after[s] / (1, 2, 3)[k % 3]
            assert all(after[x] <= level * (1, 2, 3)[j % 3] + 3 for j, x in enumerate(sorted(before, key=lambda s: (s is None, s or ""))))
    assert abs(sum(after.values()) - sum(before.values())) <= len(before)
    bins = defaultdict(list)
    for r in rows["pack"]:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= 1024
    assert len({(r["doc_id"]) for r in rows["pack"]}) == len({r["doc_id"] for r in rows["mix"]})


def test_run_leaves_what_its_result_reads(spark, sf_dir):
    mark = runtime.scratch_mark()
    out = p.run(spark, sf_dir)
    assert out.count() > 0
    left = runtime._MADE[mark:]
    assert not any("stage-language" in x or "stage-near" in x or "signatures" in x for x in left) and any("stage-mix" in x for x in left)
    runtime.empty_scratch(spark, mark)
    assert runtime.scratch_mark() == mark
