"""Operators on documents, against brute force."""

import hashlib
import math
import re
import zlib
from array import array
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeloom.llm import cdc, components, digest, fst_tokens, langid, minmax, mixing, packing, pfor
from lakeloom.llm.encode import MergeEncoder, PieceEncoder, make_encoder
from lakeloom.llm.queries import vocabulary

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BYTE, WORDS = vocabulary("byte_bpe_50k.json"), vocabulary("word_bpe_49k.json")


def rows(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.select(*columns).collect()]


def library(path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return lambda t: tokenizer.encode(t or "", add_special_tokens=False).ids


# 1 ------------------------------------------------------------------------------------------------------------------
def targets(sizes):
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    total, target, capped = sum(sizes.values()), {}, set()
    while True:
        free = [s for s in sizes if s not in capped]
        left = total - sum(3 * sizes[s] for s in capped)
        target = {s: 3.0 * sizes[s] for s in capped} | {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if target[s] > 3 * sizes[s]]
        if not over:
            return target
        capped |= set(over)


@pytest.mark.parametrize("which", ["docs", "odd", "none"])
def test_mix(which, request):
    table = request.getfixturevalue(which)
    mixed = mixing.mix(table).cache()
    got = rows(mixed, "doc_id", "source", "text", "_size", "_source_size", "_target", "_taken")
    assert len(got) == table.count()
    sizes = Counter()
    for _, s, t, n, *_ in got:
        assert n == len(WORD.findall(t or ""))
        sizes[s] += n
    want = targets(sizes) if sizes else {}
    taken = Counter()
    for _, s, _, n, all_, target, k in got:
        assert all_ == sizes[s] and math.isclose(target, want[s], rel_tol=1e-9, abs_tol=1e-9) and 0 <= k <= 3 * n
        taken[s] += k
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    assert sorted(map(repr, got)) == sorted(map(repr, rows(mixing.mix(table), "doc_id", "source", "text", "_size", "_source_size", "_target", "_taken")))
    made = Counter()
    for s, t in rows(mixing.mixed_rows(mixed), "source", "text"):
        made[s] += len(WORD.findall(t))
    assert made == Counter({s: k for s, k in taken.items() if k})


def test_mix_of_ties(spark):
    """Rows with one doc_id or none, equal rows, and a row that is a third of all: targets are met, and reruns agree."""
    texts = [f"w{i} " * (1 + i % 9) for i in range(300)]
    data = [(i if i % 3 else None if i % 2 else 7, t, "ab"[i % 2]) for i, t in enumerate(texts)] + [(5, "one two three four five", "a")] * 200
    table = spark.createDataFrame(data, "doc_id long, text string, source string")
    for share in (1.0, 0.3, 0.01):
        for seed in range(4):
            columns = ["doc_id", "source", "text", "_size", "_source_size", "_taken"]
            got, again = (sorted(rows(mixing.mix(t, share=share, seed=seed), *columns), key=repr) for t in (table, table.repartition(7)))
            assert got == again and len(got) == len(data)
            taken, sizes = Counter(), Counter()
            for _, s, t, n, _, k in got:
                assert n == len(t.split()) and 0 <= k <= 3 * n
                taken[s] += k
                sizes[s] += n
            all_ = share * sum(sizes.values())
            want = {"a": min(all_ / 3, 3 * sizes["a"]), "b": min(2 * all_ / 3, 3 * sizes["b"])}
            if share == 1.0:
                want = targets(sizes)
            assert all(abs(taken[s] - want[s]) <= 1 for s in want)
            assert sum(k % n > 0 for *_, n, _, k in got) <= 2


def test_mix_without_text_gives_the_same_counts(docs):
    words = docs.select("doc_id", "source", mixing.n_words(F.col("text")).alias("size"))
    got = Counter()
    for s, k in rows(mixing.mix(words, F.col("size")), "source", "_taken"):
        got[s] += k
    want = Counter()
    for s, k in rows(mixing.mix(docs), "source", "_taken"):
        want[s] += k
    assert got == want


def test_mix_is_native(docs):
    plan = mixing.mix(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# 2 ------------------------------------------------------------------------------------------------------------------
def test_language(docs):
    got = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    truth = dict(rows(docs, "doc_id", "lang"))
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    held = [i for i, r in got.items() if r["held_out"]]
    assert np.mean([got[i]["lang_pred"] == truth[i] for i in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_language_odd(odd, none):
    got = rows(langid.identify(odd), "doc_id", "lang_pred", "score")
    assert len(got) == odd.count()
    assert {i for i, lang, _ in got if lang == "und"} == {3, 4, 5, 11}
    assert langid.identify(none).count() == 0
    assert {r[0] for r in rows(langid.predict(odd, langid.learn(none)), "lang_pred")} == {"und"}


def test_language_without_letters(spark, docs):
    texts = spark.createDataFrame([(1, "½ " * 20), (2, "½ " * 20 + "the"), (3, "1 2 - _ " * 9)], "doc_id long, text string")
    got = dict(rows(langid.predict(texts, langid.learn(docs)), "doc_id", "lang_pred"))
    assert got[1] == got[3] == "und" and got[2] != "und"


def test_language_mixture(docs):
    model = langid.learn(docs)
    text = {k: [] for k in ("en", "de")}
    for t, lang in rows(docs.filter("lang in ('en', 'de')").orderBy("doc_id").limit(200), "text", "lang"):
        text[lang] += langid.words_of(t)
    full, selected = langid.Mixer(model).batch([text["en"][:300] + text["de"][:100], text["de"][:400]])
    names = model.languages
    assert {names[i] for i in np.flatnonzero(selected[0])} == {"de", "en"} and abs(full[0][names.index("en")] - 0.75) < 0.08
    assert [names[i] for i in np.flatnonzero(selected[1])] == ["de"]


def test_expectation_maximisation():
    """Proportions and the set of languages, against the plain form of both."""
    rng = np.random.default_rng(22)
    names = ["a", "b", "c", "d"]
    table = np.log(rng.dirichlet(np.full(langid.PLACES, 0.3), len(names)).T + 1e-9)
    model = langid.Model(names, table)
    words = ["".join(rng.choice(list("abcdefgh"), rng.integers(1, 9))) for _ in range(60)]
    lists = [list(rng.choice(words, n)) for n in (1, 2, 5, 40, 300)]
    like = {w: [sum(table[g][k] for g in langid.trigrams([w])[0].tolist()) for k in range(4)] for w in words}

    def em(x, theta, rounds):
        for _ in range(rounds):
            new = [0.0] * 4
            for w in x:
                p = [t * math.exp(v - max(like[w])) for t, v in zip(theta, like[w], strict=True)]
                new = [a + b / max(sum(p), 1e-300) for a, b in zip(new, p, strict=True)]
            theta = [a / len(x) for a in new]
        value = sum(math.log(max(sum(t * math.exp(v - max(like[w])) for t, v in zip(theta, like[w], strict=True)), 1e-300)) + max(like[w]) for w in x)
        return theta, value

    full, selected = langid.Mixer(model).batch(lists)
    for x, f, s in zip(lists, full, selected, strict=True):
        theta, _ = em(x, [0.25] * 4, langid.ROUNDS)
        assert np.allclose(f, theta, atol=1e-9)
        penalty = 0.5 * math.log(len(x))
        single = [sum(like[w][k] for w in x) for k in range(4)]
        best, want = max(single) - penalty, {names[int(np.argmax(single))]}
        order = sorted(range(4), key=lambda k: -theta[k])
        for n in range(2, 5):
            t, value = em(x, [1 / n if k in order[:n] else 0.0 for k in range(4)], langid.SET_ROUNDS)
            if value - n * penalty <= best:
                break
            best, want = value - n * penalty, {names[k] for k in order[:n] if t[k] > 0}
        assert {names[k] for k in np.flatnonzero(s)} == want


def test_language_memory_is_bounded(docs, monkeypatch):
    model, texts = langid.learn(docs), [langid.words_of(t) for (t,) in rows(docs.limit(60), "text")] + [["x" * 5000, "the"]]
    texts = [x for x in texts if x]
    want = langid.Mixer(model).batch(texts)
    monkeypatch.setattr(langid, "KEPT_CELLS", 400)
    monkeypatch.setattr(langid, "BATCH_CELLS", 1000)
    mixer = langid.Mixer(model)
    for x, full in zip(texts, want[0], strict=True):
        assert np.allclose(mixer.batch([x])[0][0], full)
        assert len(mixer.likely) <= 3072 + 2 * len(set(x))


def test_words_keep_their_vowel_signs():
    assert langid.words_of("हिन्दी भाषा, ภาษาไทย 12 caf\u0065\u0301 x_y") == ["हिन्दी", "भाषा", "ภาษาไทย", "cafe\u0301", "x", "y"]


# 3 ------------------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("which", ["docs", "odd", "none"])
def test_token_files(which, request, spark, tmp_path):
    table = request.getfixturevalue(which)
    encode = library(WORDS)
    want, at = [], 0
    for i, t, _ in sorted(rows(table.withColumn("h", F.xxhash64("text")), "doc_id", "text", "h"), key=lambda r: (r[0] is not None, r[0] or 0, r[2])):
        ids = [*encode(t), 2]
        want.append((i, at, len(ids), zlib.crc32(array("I", ids).tobytes())))
        at += len(ids)
    folder = pfor.write_token_files(table, WORDS, 2, str(tmp_path / "files"))
    got = rows(pfor.read_token_files(spark, folder), "doc_id", "start", "n_tokens", "ids_crc32")
    assert sorted(got, key=lambda r: r[1]) == want
    images = [b for f in (tmp_path / "files").glob("part-*") if (b := f.read_bytes())]  # a loader without Spark
    ids = [x for b in sorted(images, key=pfor.image_place) for x in pfor.read_image(b)[2].tolist()]
    assert len(ids) == at and (at == 0 or ids[-1] == 2)


def test_token_files_without_ids(spark):
    """Rows without a doc_id are dealt to several files, and none is lost."""
    n = 4000
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    table = spark.range(n).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    folder = pfor.write_token_files(table, WORDS, 2)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = [pfor.read_image(bytes(r["content"]))[0] for r in spark.read.format("binaryFile").load(folder).collect()]
    assert sum(map(len, files)) == n and len(files) > 1 and max(map(len, files)) < n / 2
    got = sorted(rows(pfor.read_token_files(spark, folder), "start", "n_tokens"))
    assert all(a + k == b for (a, k), (b, _) in zip(got, got[1:], strict=False))


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 1000])
def test_blocks(n):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, 1 << 16, n), np.full(n, 7), np.where(rng.random(n) < 0.05, (1 << 32) - 1, rng.integers(5, 9, n))):
        ids = ids.astype(np.uint32)
        keys, lengths, back = pfor.read_image(pfor.write_image([3, None], [n, 0], ids))
        assert keys == [3, None] and lengths.tolist() == [n, 0] and (back == ids).all()
        assert pfor.image_place(pfor.write_image([3, None], [n, 0], ids, 7, 1 << 40)) == (7, 1 << 40)
        index, payload = pfor.pack(ids)
        if n > 300:  # a block alone
            index = np.frombuffer(index, pfor.INDEX)
            assert (pfor.unpack(index, np.frombuffer(payload, np.uint8), 1, 2) == ids[128:256]).all()


# 6 ------------------------------------------------------------------------------------------------------------------
def shingles(text, k):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute_components(ids, sets, percent):
    part = {i: i for i in ids}

    def root(i):
        while part[i] != i:
            i = part[i]
        return i

    where = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    pairs = {(a, b) for found in where.values() for a in found for b in found if a < b}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            a, b = root(a), root(b)
            part[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("k, percent", [(3, 85), (5, 80)])
def test_near_duplicates(docs, k, percent):
    texts = dict(rows(docs, "doc_id", "text"))
    sets = {i: shingles(t, k) for i, t in texts.items()}
    want = brute_components(texts, sets, percent)
    got = rows(minmax.near_duplicates(docs, k, percent), "doc_id", "n_shingles", "component_id", "kept")
    assert sorted(got) == sorted((i, len(sets[i]), want[i], want[i] == i) for i in texts)


def test_near_duplicates_chains(spark):
    """A large group of near copies, chained so that most aren't linked with the group's least document."""
    words = [f"w{i}" for i in range(400)]
    texts = {}
    for i in range(300):
        w = list(words)
        for j in range(i % 20):
            w[(i * 7 + j * 13) % 400] = f"x{i}_{j}"
        texts[1000 - i] = " ".join(w)
    sets = {i: shingles(t, 3) for i, t in texts.items()}
    want = brute_components(texts, sets, 85)
    got = rows(minmax.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), 3, 85, 24, 5), "doc_id", "component_id")
    assert dict(got) == want


def test_near_duplicates_odd(odd, none):
    got = rows(minmax.near_duplicates(odd, 3, 85, 24, 5), "doc_id", "component_id", "kept")
    assert len(got) == odd.count()
    by = dict(r[:2] for r in got)
    assert by[2] == by[12] == 1 and by[3] == 3 and by[4] == 4 and by[5] == 5 and (None, None, True) in got
    assert minmax.near_duplicates(none).count() == 0


def test_signature_estimates_similarity():
    rng = np.random.default_rng(3)
    common, own = rng.integers(0, 1 << 63, 800).astype(np.uint64), rng.integers(0, 1 << 63, 400).astype(np.uint64)
    a, b = np.unique(np.concatenate([common, own[:200]])), np.unique(np.concatenate([common, own[200:]]))
    s = minmax.signatures([a, b], 4000, 1)
    assert abs(np.mean(s[0] == s[1]) - 800 / 1200) < 0.03


def test_components(spark):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5), (None, 3)]
    part = {i: i for e in edges for i in e if i is not None}
    for _ in range(100):
        for a, b in edges:
            if a is not None:
                part[a] = part[b] = min(part[a], part[b])
    got = dict(rows(components.connected_components(spark.createDataFrame(edges, "a long, b long")), "id", "component_id"))
    assert all(part[i] == c for i, c in got.items()) and {i for e in edges for i in e if None not in e and e[0] != e[1]} == set(got)


# 7 ------------------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("which", ["docs", "odd", "none"])
def test_packing(which, request):
    table = request.getfixturevalue(which)
    got = rows(packing.pack_documents(table, BYTE, 2, 1024), "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
    want, tokens = Counter(), 0
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(BYTE)
    for i, t in rows(table, "doc_id", "text"):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 2]
        tokens += len(ids)
        at = 0
        for k, (start, n) in enumerate(packing.cut(len(ids), 1024)):
            assert start == at and 0 < n <= 1024 and (k == 0 or n == 1024)
            at += n
            want[i, k, start, n, zlib.crc32(array("I", ids[start : start + n]).tobytes())] += 1
        assert at == len(ids)
    assert Counter(r[:5] for r in got) == want
    bins = defaultdict(list)
    for *_, n, _, s, o in [(r[0], r[3], r[4], r[5], r[6]) for r in got]:
        bins[s].append((o, n))
    for places in bins.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= 1024
    if which == "docs":
        assert len(bins) <= 1.01 * math.ceil(tokens / 1024)


def test_large_items_match_in_pairs():
    kinds = packing.plan({600: 3, 400: 2, 350: 5, 100: 4, 20: 50}, 1024)
    held = Counter()
    for lengths, many in kinds:
        assert sum(lengths) <= 1024 and sum(n > 341 for n in lengths) <= 2
        for n in lengths:
            held[n] += many
    assert held == {600: 3, 400: 2, 350: 5, 100: 4, 20: 50}


# 8 ------------------------------------------------------------------------------------------------------------------
def test_repeats(spark):
    rng = np.random.default_rng(8)
    w = lambda n: " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 9))) for _ in range(n))
    passages = [w(55) for _ in range(40)]
    texts = {i: w(int(rng.integers(5, 400))) for i in range(400)}
    planted = set()
    for p, passage in enumerate(passages):
        for i in rng.choice(400, 4, replace=False):
            texts[int(i)] += f" {passage} " + w(30)
            planted.add((int(i), p))
    first = {p: min(i for i, q in planted if q == p) for p in range(40)}
    table = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    out = {r["doc_id"]: r for r in cdc.remove_repeats(table).collect()}
    late = {i for i, p in planted if i != first[p]}
    caught = [i for i in late if out[i]["_n_removed"]]
    assert len(caught) >= 0.98 * len(late)
    assert all(out[i]["text"] == texts[i] and not out[i]["_spans"] for i in texts if i not in late)
    for i, p in planted:
        if i == first[p]:
            assert passages[p][60:200] in out[i]["text"] or i in late
        elif out[i]["_n_removed"]:
            assert first[p] in out[i]["_first_ids"] or len(passages[p]) < 300
    for i in caught:  # what is left and what was cut out make up the text
        t, left, at = texts[i], [], 0
        for s in out[i]["_spans"]:
            left.append(t[at : s["start"]])
            at = s["start"] + s["length"]
        assert "".join([*left, t[at:]]) == out[i]["text"]


def test_chunks_resist_shifts():
    rng = np.random.default_rng(9)
    data = bytes(rng.integers(97, 123, 4000).astype(np.uint8))
    a, b = set(cdc.chunk_digests(data)[1].tolist()), set(cdc.chunk_digests(data[:1000] + b"inserted" + data[1000:])[1].tolist())
    assert len(a & b) >= len(a) - 3
    h = 0
    for i, x in enumerate(data):  # the rolling form of the same hash
        h = (h << 1) + int(cdc.GEAR[x]) & 0xFFFF
        if i > 20:
            assert (i + 1 in set(cdc.cuts(data).tolist())) == (h < cdc.CUT_BELOW) or i + 1 == len(data)


def test_repeats_odd(odd, none):
    out = cdc.remove_repeats(odd)
    got = rows(out, "doc_id", "text", "_n_removed", "component_id")
    assert len(got) == odd.count() and out.columns[: len(odd.columns)] == odd.columns
    assert all(n == 0 for i, _, n, _ in got if i in (1, 3, 4, 5, None))
    assert cdc.remove_repeats(none).count() == 0 and cdc.remove_repeats(none, only_changed=True).count() == 0


# 9 ------------------------------------------------------------------------------------------------------------------
def test_counts(docs, odd, none):
    lib = library(BYTE)
    got = rows(fst_tokens.count_tokens(odd, BYTE), "doc_id", "n_bytes", "n_tokens", "over_limit")
    want = [(i, len((t or "").encode()), n := len(lib(t)), n > 1024) for i, t in rows(odd, "doc_id", "text")]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert fst_tokens.count_tokens(none, BYTE).count() == 0
    enc = make_encoder(BYTE)
    want = {i: len(enc.library.encode(t).ids) for i, t in rows(docs, "doc_id", "text")}
    assert dict(rows(fst_tokens.count_tokens(docs, BYTE), "doc_id", "n_tokens")) == want


def test_transducers_and_pieces_equal_the_library():
    rng = np.random.default_rng(2)
    parts = ["'s", "'re", "'ll", "'", "''", "a", "r", "e", "l", "v", " ", "  ", "\n", "\t", "1", "²", "é", "日本", "!", ".", "<|endoftext|>", "<|startoftext|>", "\x1c", "\xa0", "　", "ſ", "T", "the", "ing", " The", "😀", "́", "ª", "Σ", "İ", "ß"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 14))) for _ in range(8000)] + ["", "a" * 2000, " " * 300, "'re", "'r", "=-" * 100, "\n\n\x1ca", "a\x1fb \x1d\n\n\x1e"]
    for path, kind in ((BYTE, MergeEncoder), (WORDS, PieceEncoder)):
        enc = make_encoder(path)
        assert type(enc) is kind
        want = [e.ids for e in enc.library.encode_batch(texts, add_special_tokens=False)]
        assert [enc.encode(t) for t in texts] == [array("I", x).tobytes() for x in want]
        if path == BYTE:
            assert fst_tokens.TokenCounter(path).count(texts).tolist() == list(map(len, want))
            long = " " * 3_000_000 + "x"  # more than tiktoken's pattern can read
            assert enc.encode(long) == array("I", enc.library.encode(long, add_special_tokens=False).ids).tobytes()


def test_long_words():
    """Words that are cut into chunks: random letters, other scripts, and periods that chunks fall out of step with."""
    rng, lib = np.random.default_rng(12), library(BYTE)
    letters = lambda alphabet, n: "".join(rng.choice(list(alphabet), n))
    machine = fst_tokens.TokenCounter(BYTE)
    texts = [letters("abcdefghijklmnopqrstuvwxyz", 30_000), letters("ACGT", 5000), "".join(map(chr, rng.integers(0x4E00, 0x9000, 4000))), "a" * 9001, "ab" * 3000, "the" * 900 + "x" + "ing" * 900, " " * 7001, "=" * 7001, "-" * 2000 + "*" * 3000, "é" * 2500, "x" * 1024, "x" * 1025, "word " + "=-" * 1300 + " tail"]
    assert machine.count(texts).tolist() == [len(lib(t)) for t in texts]
    assert len(machine.machine.states) < 5000


def test_chunks_out_of_step_are_mapped_anew(monkeypatch):
    monkeypatch.setattr(fst_tokens, "LEAD", 1)
    rng, lib = np.random.default_rng(13), library(BYTE)
    texts = ["".join(rng.choice(list("etaoins"), 6000)), "a" * 5001, "=" * 5003]
    assert fst_tokens.TokenCounter(BYTE).count(texts).tolist() == [len(lib(t)) for t in texts]


def test_states_are_bounded(monkeypatch):
    monkeypatch.setattr(fst_tokens, "KEPT_STATES", 300)
    monkeypatch.setattr(fst_tokens, "KEPT_PAIRS", 300)
    monkeypatch.setattr(fst_tokens, "STEP_BYTES", 256)
    rng, lib = np.random.default_rng(14), library(BYTE)
    texts = [" ".join("".join(rng.choice(list("abcdefgh"), 9)) for _ in range(300)) for _ in range(5)]
    machine = fst_tokens.TokenCounter(BYTE)
    assert machine.count(texts).tolist() == [len(lib(t)) for t in texts] and len(machine.machine.states) < 300 + 300


def test_every_code_point_is_divided_alike():
    """tiktoken, the transducers and the tokenizers library on each code point, beside letters, digits, signs and spaces."""
    enc, machine = make_encoder(BYTE), fst_tokens.TokenCounter(BYTE)
    points = [chr(c) for c in [*range(0xD800), *range(0xE000, 0x110000)]]
    for form in ("a{0}b", "1{0}{0}2", " {0}!", "{0} {0}'s"):
        texts = [" | ".join(form.format(c) for c in points[k : k + 64]) for k in range(0, len(points), 64)]
        want = [e.ids for e in enc.library.encode_batch(texts, add_special_tokens=False)]
        assert [enc.encode(t) for t in texts] == [array("I", x).tobytes() for x in want]
        assert machine.count(texts).tolist() == list(map(len, want))


# 10 -----------------------------------------------------------------------------------------------------------------
def edited_brute(table):
    order = sorted(rows(table, "doc_id", "text"), key=lambda r: (r[0] is not None, r[0] or 0))
    texts = [t or "" for _, t in order]
    for k, (i, _) in enumerate(order):
        t, following = texts[k], texts[(k + 1) % len(texts)]
        q = len(t) // 4
        yield i, t, (t[:-q] if q else t) + following[:q], following


def test_fingerprints(docs):
    got = {r["doc_id"]: r for r in digest.fingerprint(docs).collect()}
    assert len(got) == docs.count()
    forms = {}
    for i, t, edited, following in edited_brute(docs):
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        same = lambda x: digest.canonical(x) == digest.canonical(t)  # noqa: B023, E731
        assert (r["near_edited"], r["near_next"]) == (float(same(edited)), float(same(following)))
        assert forms.setdefault(r["fingerprint"], digest.canonical(t)) == digest.canonical(t)
    assert len(forms) == len(set(forms.values()))


def test_fingerprints_odd(odd, none, spark):
    got = rows(digest.fingerprint(odd), "doc_id", "n_chars", "edited_sha256", "fingerprint")
    assert len(got) == odd.count()
    by = {i: f for i, _, _, f in got if i != 6}
    assert by[1] == by[2] == by[12] and by[3] == by[4] == by[5] and by[9] != by[1]
    want = {i: e for i, _, e, _ in edited_brute(odd) if i not in (5, 6)}
    assert {i: s for i, _, s, _ in got if i in want} == {i: hashlib.sha256(e.encode()).hexdigest() for i, e in want.items()}
    assert digest.fingerprint(none).count() == 0
    one = digest.fingerprint(spark.createDataFrame([(7, "abcd")], "doc_id long, text string")).first()
    assert one["edited_sha256"] == hashlib.sha256(b"abca").hexdigest()


def test_shared_digests_are_told_apart(docs):
    got = digest.fingerprint(docs, digest=lambda b: digest.narrow(b)[:2] + "000").select("doc_id", "fingerprint")
    texts = dict(rows(docs, "doc_id", "text"))
    by = defaultdict(set)
    for i, f in rows(got, "doc_id", "fingerprint"):
        by[f].add(digest.canonical(texts[i]))
    assert all(len(x) == 1 for x in by.values()) and len(by) == len({digest.canonical(t) for t in texts.values()})


# pipeline -----------------------------------------------------------------------------------------------------------
def test_pipeline(spark, docs):
    import corpus_pipeline as p

    at, seen = docs.limit(400), {}
    for name, stage in p.STAGES:
        at = stage(spark, at, None).cache()
        seen[name] = at
        if name != "pack":
            assert at.columns == docs.columns
    assert p.run.__doc__ or [n for n, _ in p.STAGES] == ["language", "near_duplicates", "repeats", "mix", "pack"]
    assert seen["mix"].count() > 0 and seen["pack"].agg(F.max("length")).first()[0] <= 1024


def test_pipeline_odd(spark, odd, none):
    import corpus_pipeline as p

    for at in (odd, none):
        for name, stage in p.STAGES:
            at = stage(spark, at, None).cache()
            at.count()
            if name == "language":
                assert {r[0] for r in rows(at, "doc_id")} & {3, 4, 5, 11} == set()
