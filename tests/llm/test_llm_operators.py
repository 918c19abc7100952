"""Each operator against brute force, with nulls, empty and long texts, repeats, empty tables and clashing columns."""

import base64
import random
import re
import shutil
import sys
import zlib
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402
import public_tokenizers as P  # noqa: E402

from kinespark.llm import byte_bpe, decontaminate, id_store, license_scan, media, ngram_join, quality, substring_dedup, token_count, units, url_filter  # noqa: E402

DOCS = "doc_id long, text string, lang string, id long, n long, keys string, unit string, digest string"
WORDS = [f"w{i}" for i in range(300)]


def corpus(seed=3):
    """Texts with exact and near copies, shared passages, very short and very long ones, odd characters and nulls."""
    r = random.Random(seed)
    make = lambda n: " ".join(r.choices(WORDS, k=n))
    base, passage = make(200), make(70)
    out = [None, "", " \n\t ", "one", "Two  Words", base, base, base.upper(), make(9), passage, "x" * 5000, "a a " * 700, "naïve café ☕ ́e\u3000日本語 <s> <|endoftext|> \x00 \x1c\x85 \u2581"]
    for i in range(12):
        words = base.split()
        for _ in range(i):
            words[r.randrange(len(words))] = r.choice(WORDS)
        out.append(" ".join(words))
    for _ in range(8):
        out.append(f"{make(30)}\n{passage}\n{make(20)}")
    out += [f"{make(40)}, Benchmark." for _ in range(5)] + [make(6000)]
    return [(i, t) for i, t in enumerate(out)]


def frame(spark, rows, parts=3):
    made = [(i, t, "en" if i is None or i % 2 else None, 7, 8, "k", "u", "d") for i, t in rows]
    return spark.createDataFrame(made, DOCS).repartition(parts)


def empty(spark):
    return spark.createDataFrame([], DOCS)


# ---- 1 ----
@pytest.mark.parametrize(("k", "num", "den"), [(3, 90, 100), (5, 80, 100), (2, 60, 100)])
def test_components_match_brute_force(spark, k, num, den):
    rows = corpus()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(frame(spark, rows), words=k, threshold=(num, den)).collect()}
    assert got == brute.jaccard_components(rows, k, num, den)


def test_class_links_count_every_link(spark, monkeypatch):
    r = random.Random(4)
    base = r.choices(WORDS, k=200)
    texts = [" ".join(base)] * 3
    for i in range(25):  # near copies of one text, which link with each other too
        words = list(base)
        words[7 * i] = f"new{i}"
        texts += [" ".join(words)] * (1 + i % 2)
    rows = [*corpus(), *((100 + i, t) for i, t in enumerate(texts)), (103, texts[3])]
    sets = {}
    for i, t in rows:
        w = brute.SPACE_WORD.findall((t or "").translate(brute.LOWER))
        if w:
            sets.setdefault(frozenset(tuple(w[j : j + 3]) for j in range(len(w) - 2)) or frozenset([tuple(w)]), set()).add(i)
    want = {}
    for a, ids in sets.items():
        n = sum(len(other) for b, other in sets.items() if a != b and 100 * len(a & b) >= 90 * len(a | b))
        want |= {i: (min(ids), n) for i in ids}
    assert max(n for _, n in want.values()) > 30
    monkeypatch.setattr(ngram_join, "HOT_BUCKET", 4)
    found = ngram_join.near_duplicates(frame(spark, rows), words=3, threshold=(90, 100)).collect()
    assert {x.doc_id: (x.class_id, x.class_links) for x in found if x.n_shingles} == want
    few = ngram_join.near_duplicates(frame(spark, rows), words=3, threshold=(90, 100), count_links=False).collect()
    assert sorted((x.doc_id, x.component_id) for x in few) == sorted((x.doc_id, x.component_id) for x in found)


def test_unlike_pairs_do_not_carry_their_sets(spark, monkeypatch):
    """Of pairs that share a bucket only those bring their tokens that may link; rounds change nothing."""
    r = random.Random(8)
    texts = [r.choices(WORDS, k=r.choice((30, 400, 3000))) for _ in range(24)]
    texts += [[*t[:-1], "end"] for t in texts[:6]]
    base = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "id long, text string")
    pairs = spark.createDataFrame([(a, b) for b in range(len(texts)) for a in range(b)], "a long, b long")
    kept, write = {}, ngram_join.write_shared

    def watched(df, name):
        out = write(df, name)
        kept.setdefault(name, []).append(out.df.count())
        return out

    monkeypatch.setattr(ngram_join, "write_shared", watched)
    want = {(i, 24 + i) for i in range(6)}
    for most in (ngram_join.ROUND_TOKENS, 1):
        monkeypatch.setattr(ngram_join, "ROUND_TOKENS", most)
        got = ngram_join._verified(pairs, base, 5, 80, 100)
        assert {(x.a, x.b) for x in got.df.collect()} == want
    assert kept["pairs"] == [435, 435] and max(kept["near"]) < 12
    monkeypatch.setattr(ngram_join, "may_link_wide", lambda *_: ngram_join.F.lit(True))  # all pairs: several rounds
    assert {(x.a, x.b) for x in ngram_join._verified(pairs, base, 5, 80, 100).df.collect()} == want
    assert len(kept["links"]) > 4


def test_components_in_one_task_and_by_joins(spark):
    r = random.Random(6)
    edges = [(r.randrange(300) * 7 + 1, r.randrange(300) * 7 + 1) for _ in range(200)] + [(5000 + i, 5001 + i) for i in range(40)] + [(1 << 61, 4)]
    for rows in (edges, [], [(3, 3)]):
        df = spark.createDataFrame(rows, "a long, b long")
        one, joined = ({(x.node, x.root) for x in ngram_join.components(df, few=few).df.collect()} for few in (1000, -1))
        assert one == joined and len(one) == len({e for a, b in rows if a != b for e in (a, b)})


def test_join_degenerate_inputs(spark):
    assert ngram_join.near_duplicates(empty(spark)).count() == 0
    rows = [(None, "a b c"), (5, "a b c"), (5, "a b c"), (9, "c b a"), (4, None)]
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(frame(spark, rows)).collect())
    assert got == [(-1, 1, 5), (4, 0, 4), (5, 1, 5), (5, 1, 5), (9, 1, 9)]
    near = " ".join(WORDS[:100])
    rows = [(None, f"{near} x"), (7, near), (None, f"{near} y"), (None, "p q r s t u"), (None, "p q r s t u"), (None, None)]
    got = sorted((r.doc_id or -1, r.n_shingles, r.class_id or -1, r.component_id or -1) for r in ngram_join.near_duplicates(frame(spark, rows)).collect())
    assert got == [(-1, 0, -1, -1), (-1, 2, -1, -1), (-1, 2, -1, -1), (-1, 97, -1, 7), (-1, 97, -1, 7), (7, 96, 7, 7)]


def test_a_large_cluster_of_near_copies(spark):
    r = random.Random(8)
    base = [f"b{i}" for i in range(700)]  # large sets, whose 256 parity bits say nothing
    rows = []
    for i in range(160):
        words = list(base)
        for _ in range(r.choice((1, 4, 11, 30))):
            words[r.randrange(700)] = f"n{r.randrange(10**9)}"
        rows.append((i, " ".join(words)))
    for count in (True, False):
        got = {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_join.near_duplicates(frame(spark, rows), count_links=count).collect()}
        assert got == brute.jaccard_components(rows, 5, 80, 100)


def test_signatures_meet_for_every_similar_pair():
    import numpy as np

    r = np.random.default_rng(1)
    for num, den in ((90, 100), (80, 100), (60, 100)):
        for n in [*range(1, 40), 90, 400, 2000]:
            for _ in range(8 if n < 100 else 3):
                x = r.integers(0, 1 << 63, n).astype(np.uint64)
                most = n * (den - num) // den  # dropping that many keeps the similarity
                y = x[: n - int(r.integers(0, most + 1))]
                if r.random() < 0.5:  # substitutions and additions
                    k = int(r.integers(0, n * (den - num) // (num + den) + 1))
                    y = np.concatenate([x[k:], r.integers(0, 1 << 63, k).astype(np.uint64)])
                both = len(np.intersect1d(x, y))
                if den * both >= num * (len(np.union1d(x, y))):
                    assert np.intersect1d(ngram_join.signatures(np.unique(x), num, den), ngram_join.signatures(np.unique(y), num, den)).size, (num, n)


def test_band_plan_covers_the_threshold():
    for num, den in ((90, 100), (80, 100)):
        for band in range(1, 40):
            m, q, slack, m2, slack2 = ngram_join.band_plan(band, num, den)
            upper = ngram_join.band_edges(num, den)[band + 1] - 1
            most = upper * (den - num) // num
            assert m + q == most + 1 + slack and m2 == most + 1 + slack2 and 0 <= q <= m


# ---- 2 ----
def test_token_counts(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    rows = corpus()
    for tier in (0, 50, 65_536):
        got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_count.token_counts(frame(spark, rows), P.path("piece_bpe_32k.model"), limit=100, tier_one=tier, cache=20).collect()}
        assert got == {i: (len((t or "").encode()), n := len(model.encode(t or "")), n > 100) for i, t in rows}
    assert token_count.token_counts(empty(spark), P.path("piece_bpe_32k.model")).count() == 0


def test_units_rebuild_the_text():
    for _, t in corpus():
        assert "".join(units.units(t)) == (t or "") == "".join(units.space_units(t))


# ---- 3 ----
def bench(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("block", [64 << 20, 200])
def test_decontamination(spark, block):
    rows = corpus()
    items = [(1, rows[9][1][:200]), (2, "W1 w2"), (3, None), (4, ""), (5, "one"), (60, rows[9][1].upper()), (7, "café ☕")]
    got = {r.doc_id: r for r in decontaminate.decontaminate(frame(spark, rows), bench(spark, items), max_pattern_bytes=block).collect()}
    want = brute.contamination(rows, items, 10)
    text = dict(rows)
    for i, w in want.items():
        assert (got[i].n_words, got[i].n_hit, len(got[i]["items"]), brute.sha(",".join(got[i]["items"])), got[i].n_hit > 0) == w, i
        hit = sum(len(brute.BENCH_WORD.findall(text[i][s.start : s.end].translate(brute.LOWER))) for s in got[i].spans)
        assert hit == w[1]
    assert decontaminate.decontaminate(empty(spark), bench(spark, items)).count() == 0
    assert all(r.n_hit == 0 for r in decontaminate.decontaminate(frame(spark, rows), bench(spark, [])).collect())


def test_blocks_of_items_change_nothing(spark):
    rows = [*corpus(), (5, corpus()[9][1]), (None, corpus()[9][1]), (5, None)]
    items = [(1, rows[9][1][:200]), (2, "W1 w2"), (5, "one"), (60, rows[9][1].upper()), (7, "café ☕")]
    docs = frame(spark, rows).withColumn("lang", brute_lang())
    one, many = (sorted(map(str, decontaminate.decontaminate(docs, bench(spark, items), max_pattern_bytes=size, keep=("lang", "keys")).collect())) for size in (64 << 20, 200))
    assert one == many and len(one) == len(rows)
    with pytest.raises(ValueError, match="items"):
        decontaminate.decontaminate(docs.withColumn("items", docs.n), bench(spark, items), keep=("items",))


def brute_lang():
    from pyspark.sql import functions as F

    return F.concat(F.lit("x"), F.coalesce(F.length("text"), F.lit(0)).cast("string"))


def test_spans_are_of_the_original_text():
    found = decontaminate.patterns([(1, "Alpha beta")], 10)
    _, ranges, ids = decontaminate.scan(decontaminate.automaton(found), "The ALPHA--Beta end")
    assert ranges == [(1, 2)] and ids == {1}
    assert decontaminate.remove_spans("The ALPHA--Beta end", [(4, 15)]) == "The  end"


# ---- 4 ----
def test_model_is_normalised_and_rejects_junk(spark):
    r = random.Random(5)
    good = [" ".join(r.choices(WORDS[:60], k=80)) for _ in range(160)]
    junk = [" ".join(f"{w.upper()}!!" for w in r.choices(WORDS, k=80)) for _ in range(10)]
    rows = list(enumerate([*good, *junk, "", None]))
    docs = frame(spark, rows)
    trusted = spark.createDataFrame([(i,) for i in range(100)], "doc_id long")
    got = {x.doc_id: x for x in quality.classify(docs, trusted).collect()}
    assert len(got) == len(rows)
    assert not any(got[i].keep for i in range(160, 170))
    assert sum(got[i].keep for i in range(160)) >= 155
    assert got[170].keep and got[171].keep and got[170].perplexity is None
    assert all(x.keep for x in quality.classify(docs, trusted.limit(0)).collect())
    assert quality.classify(empty(spark), trusted).count() == 0


def test_keep_follows_the_held_out_quantile(spark):
    import math
    import statistics

    from pyspark.sql import functions as F

    r = random.Random(9)
    noisy = lambda share: " ".join(r.choice(WORDS) if r.random() < share else r.choice(WORDS[:60]) for _ in range(80))
    docs = frame(spark, list(enumerate([noisy(0.02) for _ in range(400)] + [noisy(i / 100) for i in range(100)])))
    got = quality.classify(docs, spark.range(300).select(F.col("id").alias("doc_id"))).withColumn("held", F.pmod(F.xxhash64("doc_id"), F.lit(10)) == 0).collect()
    by = {}
    for x in got:
        if x.held and x.doc_id < 300:
            by.setdefault(x.lang, []).append((x.n_words * math.log(x.perplexity), x.n_words))
    mean = {lang: sum(a for a, _ in v) / sum(n for _, n in v) for lang, v in by.items()}
    plain = lambda lang, nll, n: (nll + 20 * mean[lang]) / (n + 20)
    z, within = statistics.NormalDist().inv_cdf(0.995), 0
    assert set(by) == {"en", None}
    for lang, v in by.items():
        held = sorted(plain(lang, *x) for x in v)
        at = held[math.ceil(0.995 * len(held)) - 1]
        limit = at + statistics.stdev(held) * math.sqrt((1 + z * z / 2) / len(held))
        for x in (x for x in got if x.lang == lang):
            own = plain(lang, x.n_words * math.log(x.perplexity), x.n_words)
            assert abs(x.score - own) < 1e-6 and abs(x.threshold - limit) < 1e-6
            assert x.keep == (own <= limit)
            within += not x.keep and own <= at + 0.5
    assert within  # the edge of 0.5 nats that a fixed margin once kept


@pytest.mark.parametrize("tier", [400_000, 3])
def test_quality_matches_a_plain_model(spark, monkeypatch, tier):
    import math
    import statistics
    from collections import Counter

    from pyspark.sql import functions as F

    monkeypatch.setattr(quality, "MOST_WORDS", 2 * tier)
    monkeypatch.setattr(quality, "MOST_BIGRAMS", tier)
    monkeypatch.setattr(quality, "CHUNK", 500)
    r = random.Random(6)
    weights = [1 / (i + 1) for i in range(len(WORDS))]
    texts = {i: " ".join(r.choices(WORDS, weights, k=r.randrange(1, 60))) for i in range(300)}
    texts |= {300 + i: " ".join(r.choices([*WORDS, "NEW", "Ünd", "x9"], k=30)) for i in range(40)}
    texts |= {400: "", 401: None, 402: "hot pair " * 400}
    langs = {i: ("en", "de", None)[i % 3] for i in texts}
    docs = spark.createDataFrame([(i, t, langs[i]) for i, t in texts.items()], "doc_id long, text string, lang string").repartition(3)
    got = {x.doc_id: x for x in quality.classify(docs, spark.range(250).withColumnRenamed("id", "doc_id")).withColumn("held", F.pmod(F.xxhash64("doc_id"), F.lit(10)) == 0).collect()}
    pairs = Counter()
    for i in range(250):
        if not got[i].held:
            w = ["<s>", *texts[i].split(), "</s>"]
            pairs.update(zip(w, w[1:], strict=False))
    d = quality._discounts([sum(c == k for c in pairs.values()) for k in (1, 2, 3, 4)])
    followers = {}
    for (a, _), c in pairs.items():
        followers.setdefault(a, []).append(c)
    cont = Counter(b for _, b in pairs)
    low = quality._discounts([sum(c == k for c in cont.values()) for k in (1, 2, 3, 4)])
    total = sum(cont.values())
    unknown = sum(low[min(c, 3)] for c in cont.values()) / total / (len(cont) + 1)
    q = lambda b: (cont[b] - low[min(cont[b], 3)] if b in cont else 0) / total + unknown
    assert abs(sum(map(q, cont)) + unknown - 1) < 1e-9

    def nll(text):
        w, out = ["<s>", *text.split(), "</s>"] if text.split() else [], 0.0
        for a, b in zip(w, w[1:], strict=False):
            f = followers.get(a, [])
            g = sum(d[min(c, 3)] for c in f) / sum(f) if f else 1.0
            out -= math.log((max(pairs[a, b] - d[min(pairs[a, b], 3)], 0) / sum(f) if f else 0.0) + g * q(b))
        return out

    plain = {i: (nll(t or ""), len((t or "").split())) for i, t in texts.items()}
    held = [i for i in range(250) if got[i].held and plain[i][1]]
    z = statistics.NormalDist().inv_cdf(0.995)
    for lang in ("en", "de", None):
        mine = [i for i in held if langs[i] == lang]
        mean = sum(plain[i][0] for i in mine) / sum(plain[i][1] for i in mine)
        score = lambda i: (plain[i][0] + 20 * mean) / (plain[i][1] + 20)
        scores = sorted(map(score, mine))
        limit = scores[math.ceil(0.995 * len(scores)) - 1] + statistics.stdev(scores) * math.sqrt((1 + z * z / 2) / len(scores))
        for i in (i for i in texts if langs[i] == lang):
            x, n = got[i], plain[i][1]
            assert x.n_words == n and abs(x.threshold - limit) < 1e-4
            assert (x.perplexity is None) == (n == 0)
            if n:
                assert abs(math.log(x.perplexity) - plain[i][0] / n) < 1e-4 and abs(x.score - score(i)) < 1e-4
                if abs(score(i) - limit) > 1e-4:
                    assert x.keep == (score(i) <= limit)
            else:
                assert x.keep
    assert not got[402].keep and not all(got[300 + i].keep for i in range(40))


# ---- 5 ----
RANKS = P.path("byte_bpe_multi_50k.tiktoken")


def tiktoken_encoder():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encoding_and_decoding(spark):
    rows, e = corpus(), tiktoken_encoder()
    for tier in (0, 300):
        got = {r.doc_id: r for r in byte_bpe.encode_decode(frame(spark, rows), RANKS, P.PATTERN, tier_one=tier, cache=50, outputs=("ids", "decoded", "n_tokens")).collect()}
        for i, t in rows:
            ids = e.encode_ordinary(t or "")
            assert (bytes(got[i].ids), bytes(got[i].decoded), got[i].n_tokens) == (brute.packed(ids), (t or "").encode(), len(ids)), i
    assert byte_bpe.encode_decode(empty(spark), RANKS, P.PATTERN).count() == 0


def test_fold_and_kernel_give_equal_merges(spark):
    ranks = byte_bpe.read_ranks(Path(RANKS).read_bytes())
    words = ["", "a", " the", "hello", "éà日本", " 12345", "!!!???", "zzzzzzzzzz", "\n\n", "ththionerly"]
    got = {r.unit: r.ids for r in byte_bpe.merge_words(spark.createDataFrame([(w,) for w in words], "unit string"), ranks).collect()}
    assert got == {w: byte_bpe.merge_ranks(w.encode(), ranks) if w else [] for w in words}
    r = random.Random(1)
    for n in (1, 5, 199, 201, 900):
        word = bytes(r.choices(b"abcdethn ", k=n))
        assert byte_bpe.merge_ranks(word, ranks) == byte_bpe._merge_long([word[i : i + 1] for i in range(n)], ranks)


def test_units_are_encoded_alone():
    e = tiktoken_encoder()
    r = random.Random(4)
    signs = ["a", "b's", " ", "  ", "\n", "\t", "é", "12", "日本", "!", "\x1c", "\x85", "\u3000", "\u200b", "'ll", "\x00"]
    for _ in range(2000):
        t = "".join(r.choices(signs, k=r.randint(0, 10)))
        assert [i for u in units.units(t) for i in e.encode_ordinary(u)] == e.encode_ordinary(t)


# ---- 6 ----
def test_store_round_trip(spark, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    rows, path = corpus(), f"{tmp_path}/store"
    id_store.write_store(frame(spark, rows), path, P.path("word_bpe_49k.json"), 2, cache=40)
    assert id_store.verify_manifest(spark, path)
    got = {r.id: (r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) for r in id_store.reconstruct(spark, path, outputs=("ids", "ids_crc32")).collect()}
    at, want = 0, {}
    for i, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        want[i] = (at, len(ids), zlib.crc32(brute.packed(ids)), brute.packed(ids))
        at += len(ids)
    assert got == want
    chunks = spark.read.parquet(f"{path}/objects").where("kind = 'chunk'")
    assert chunks.count() == chunks.select("key").distinct().count()
    recipes = spark.read.parquet(f"{path}/recipes").collect()
    schema = spark.read.parquet(f"{path}/recipes").schema
    same = [list(r) for r in recipes]
    a, b = list({tuple(map(bytes, r.recipe)): i for i, r in enumerate(recipes) if r.n > 100}.values())[:2]  # unlike recipes

    def damaged(change):
        rows = [list(r) for r in same]
        change(rows)
        bad = f"{tmp_path}/bad"
        for name in ("manifest", "objects"):
            shutil.copytree(f"{path}/{name}", f"{bad}/{name}", dirs_exist_ok=True)
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{bad}/recipes")
        with pytest.raises(ValueError, match="manifest"):
            id_store.reconstruct(spark, bad)

    def swap(rows):
        rows[a][2], rows[b][2] = rows[b][2], rows[a][2]

    damaged(swap)
    damaged(lambda rows: rows.pop(a))
    damaged(lambda rows: rows[a][2].reverse() if len(rows[a][2]) > 1 else rows[a][2].append(rows[b][2][0]))
    damaged(lambda rows: rows.append(list(rows[b])))
    id_store.delete_store(spark, path)


def test_store_of_nothing_and_of_repeats(spark, tmp_path):
    id_store.write_store(empty(spark), f"{tmp_path}/a", P.path("word_bpe_49k.json"), 2)
    assert id_store.reconstruct(spark, f"{tmp_path}/a").count() == 0
    id_store.write_store(frame(spark, [(None, "x"), (3, "same text"), (3, "same text")]), f"{tmp_path}/b", P.path("word_bpe_49k.json"), None)
    assert sorted((r.id or -1, r.start) for r in id_store.reconstruct(spark, f"{tmp_path}/b").collect()) == [(-1, 0), (3, 1), (3, 3)]


def test_cut_points_depend_on_content_only():
    import numpy as np

    r = np.random.default_rng(2)
    a, b = r.integers(0, 49_000, 700).astype(np.uint16), r.integers(0, 49_000, 9000).astype(np.uint16)
    alone = id_store.cut_points(id_store.marks(b), 0, len(b))
    both = np.concatenate([a, b])
    shifted = id_store.cut_points(id_store.marks(both), len(a), len(both))
    assert [x - len(a) for x in shifted] == alone and alone[-1] == len(b)
    assert max(np.diff([0, *alone])) <= id_store.MOST


# ---- 7 ----
def test_licenses(spark):
    mit = license_scan.KNOWN["MIT"]
    rows = [(1, f"Copyright (c) 2020 Someone\n\n{mit.upper().replace('LICENSE', 'LICENCE')}"), (2, "text\nReleased under the MIT Licence!\nmore"), (3, None), (4, ""), (5, "ééé"), (6, mit + " and more"), (2, "All rights reserved.\nall RIGHTS reserved")]
    rows += [(7, license_scan.KNOWN["BSD-3-Clause"].replace(" ", "\n")), (8, "The MIT License (MIT)\n\nCopyright 2021 X\n" + mit), (9, "licence licence licence"), (10, "acknowledgement whilst whilst Favour"), (11, "* this work is LICENCED under the gnu general public licence, version 3")]
    got = sorted((r.doc_id, r.license_id or "", r.n_license_lines, r.license_ids) for r in license_scan.scan_licenses(frame(spark, rows), known={**license_scan.KNOWN, "three": "License license license", "mixed": "acknowledgment while while favor"}).collect())
    plain = [(2, "", 1, "MIT notice"), (2, "", 2, "all rights reserved"), (3, "", 0, ""), (4, "", 0, ""), (5, "", 0, ""), (6, "", 0, "")]
    assert got == [(1, "MIT", 0, ""), *plain, (7, "BSD-3-Clause", 0, ""), (8, "MIT", 0, ""), (9, "three", 1, "three"), (10, "mixed", 1, "mixed"), (11, "GPL-3.0 notice", 1, "GPL-3.0 notice")]
    with pytest.raises(ValueError, match="digest"):
        license_scan.scan_licenses(frame(spark, rows), id_col="digest")
    assert license_scan.scan_licenses(empty(spark)).count() == 0


# ---- 8 ----
def test_url_rules(spark):
    rules = tuple(url_filter.Rule.prefix(*x) for x in (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")))
    urls = {
        "https://A.Example.ORG/es/x": ("a.example.org", "/es/x", "example.org/es/", "block"), "http://example.org/en/17?x": ("example.org", "/en/17", "example.org/en/1", "block"),
        "http://notexample.org/en/17": ("notexample.org", "/en/17", "org/", "allow"), "http://x.org": ("x.org", "", None, "allow"), "http://x.com/de/": ("x.com", "/de/", "com/de/", "block"),
        "x.com/de/": ("", "", None, "allow"), None: ("", "", None, "allow"), "": ("", "", None, "allow"), "http://x.net/casino/a": ("x.net", "/casino/a", None, "block"), "http://org/#a://b": ("org", "/", "org/", "allow"),
        "://evil.net/a.com /de/x": ("evil.net", "/a.com /de/x", None, "allow"), "://evil.net/x.org /b": ("evil.net", "/x.org /b", None, "allow"), "http://a com/de/x": ("a com", "/de/x", None, "allow"), "http://a b.com/de/x": ("a b.com", "/de/x", "com/de/", "block"),
        "http://x.comde/de/": ("x.comde", "/de/", None, "allow"), "http://org#x": ("org", "", None, "allow"), "a?b://c.com/fr/d#e": ("c.com", "/fr/d", "com/fr/", "allow"),
    }
    pages = spark.createDataFrame([(i, u, "h", "p", "r") for i, u in enumerate(urls)], "page_id long, url string, host string, path string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages, rules).collect()}
    assert got == dict(enumerate(urls.values()))
    assert url_filter.filter_urls(pages.limit(0), rules).count() == 0
    tie = tuple(url_filter.Rule.prefix(*x) for x in (("block", "x.org/"), ("allow", "x.org/"), ("allow", "org/aa"), ("block", "org/ab")))
    one = spark.createDataFrame([(1, "http://x.org/a"), (1, "http://x.org/a"), (2, "http://y.org/abc")], "page_id long, url string")
    assert sorted((r.page_id, r.rule, r.verdict) for r in url_filter.filter_urls(one, tie).collect()) == [(1, "x.org/", "block"), (1, "x.org/", "block"), (2, "org/ab", "block")]


# ---- 9 ----
def test_media_round_trip():
    for payload in (b"", b"a", b"x" * 192, bytes(range(256)) * 9, "é☕".encode() * 100):
        samples = media.padded(payload)
        assert len(samples) % 192 == 0 and len(samples) > 0 and samples.startswith(payload)
        assert media.read_png(media.write_png(samples)) == samples
    with pytest.raises(ValueError):
        media.read_png(media.write_png(media.padded(b"abc"))[:-20] + b"0" * 20)


def test_sequences_keep_order_and_captions():
    html = '<title>T</title><p>one <b>two</b></p><figure><img src="a.png" alt="alt a"><img src=b.png><figcaption>the <i>caption</i></figcaption></figure><script>no</script>three<img src="c.png" alt="alt c"><video src="d.mp4"></video> &amp; end'
    got = [(x["pos"], x["kind"], x["text"] or x["src"], x["caption"]) for x in media.parse_sequence(html)]
    assert got == [(0, "text", "T", None), (1, "text", "one two", None), (2, "media", "a.png", "the caption"), (3, "media", "b.png", "the caption"), (4, "text", "three", None), (5, "media", "c.png", "alt c"), (6, "media", "d.mp4", None), (7, "text", "& end", None)]
    assert media.parse_sequence(None) == media.parse_sequence("") == [] and media.parse_sequence("<p") is not None


def test_captions_before_and_unclosed():
    show = lambda html: [(x["text"] or x["src"], x["caption"]) for x in media.parse_sequence(html)]
    assert show('<figure><figcaption>first</figcaption><img src="a" alt="x"></figure>b') == [("a", "first"), ("b", None)]
    assert show('<figure><img src="a"><figcaption>cap</figure>rest<img src="c">') == [("a", "cap"), ("rest", None), ("c", None)]
    assert show('<figure><img src="a" alt="x"><figcaption>cap and all<p>the rest') == [("a", "x"), ("cap and all the rest", None)]
    assert show('t<figcaption>alone</figcaption><img src="a">') == [("t", None), ("alone", None), ("a", None)]
    assert show('<figure><img src="a"><figure><img src="b"><figcaption>in</figcaption></figure><figcaption>out</figcaption></figure>') == [("a", "out"), ("b", "in")]


def test_page_sequences(spark):
    d = "/root/testdata/sf0.001"
    import json

    from kinespark.llm import queries

    got = {r.page_id: r for r in queries.page_sequences(spark, d).collect()}
    pages = spark.read.parquet(f"{d}/pages.parquet").select("page_id", "html").collect()
    assert len(got) == len(pages) and sum(r.n_items for r in got.values()) > len(pages)
    for p in pages:
        items = media.parse_sequence(p.html)
        plain = [{k: v for k, v in x.items() if v is not None} for x in items]
        assert (got[p.page_id].n_items, got[p.page_id].n_media, got[p.page_id].n_captions) == (len(items), sum(x["kind"] == "media" for x in items), sum(x["caption"] is not None for x in items))
        assert got[p.page_id].sequence_sha256 == brute.sha(json.dumps(plain, ensure_ascii=False, separators=(",", ":")))


def test_media_columns(spark):
    from pyspark.sql import functions as F

    rows = corpus()
    docs = frame(spark, rows).select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("payload"))
    store = media.media_columns(media.store_payloads(docs, "payload"))
    page = F.concat(F.lit('a<img src="sha256:'), F.sha2("payload", 256), F.lit('" alt="k">b<img src="x.png">'))
    found = media.resolve(media.interleave(docs.select("doc_id", page.alias("html")), "doc_id", "html"), store, "doc_id").collect()
    assert len(found) == 2 * len(rows)
    for r in found:
        if r.pos == 3:
            assert r.src == "x.png" and r.payload_sha256 is None
            continue
        data = (dict(rows)[r.doc_id] or "").encode()
        p = data + b" " * (max(1, -(-len(data) // 192)) * 192 - len(data))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.caption) == (len(data), len(p), brute.sha(p), zlib.crc32(p[-16:]), "k")
        lines = [p[i : i + 192] for i in range(0, len(p), 192)]
        body = zlib.compress(b"".join(b"\0" + x for x in lines), 1)
        chunks = [(b"IHDR", (192).to_bytes(4) + len(lines).to_bytes(4) + b"\x08\0\0\0\0"), (b"IDAT", body), (b"IEND", b"")]
        png = b"\x89PNG\r\n\x1a\n" + b"".join(len(x).to_bytes(4) + k + x + zlib.crc32(k + x).to_bytes(4) for k, x in chunks)
        assert (r.media_bytes, r.media_sha256) == (len(png), brute.sha(png))
        bits, mean, spread = r.feature.split(",")
        assert len(bits) == 16 and abs(float(mean) - sum(p) / len(p)) < 6e-4
        assert abs(float(spread) - (sum((x - sum(p) / len(p)) ** 2 for x in p) / len(p)) ** 0.5) < 6e-4
        if len(lines) >= 8:
            cut = [i * len(lines) // 8 for i in range(9)]
            grid = [[sum(sum(x[a:b]) for x in lines[y:z]) / (b - a) / (z - y) for a, b in zip(edges(), edges()[1:], strict=False)] for y, z in zip(cut, cut[1:], strict=False)]
            want = "".join(str(int(b > a)) for row in grid for a, b in zip(row, row[1:], strict=False))
            assert f"{int(bits, 16):064b}" == want


def edges():
    return [int(192 * i / 9) for i in range(10)]


# ---- 10 ----
@pytest.mark.parametrize(("window", "prefix", "group_size"), [(50, 8, 4096), (10, 3, 4096), (4, 4, 4096), (50, 8, 3), (10, 3, 1), (1, 1, 5)])
def test_substring_dedup(spark, window, prefix, group_size):
    rows = corpus()
    got = {r.doc_id: (r.n_words, r.n_removed, brute.sha(r.kept_text or "")) for r in substring_dedup.dedup_substrings(frame(spark, rows), window=window, prefix=prefix, group_size=group_size).collect()}
    assert got == brute.substring(rows, window)


@pytest.mark.parametrize("group_size", [2, 6, 1024])
def test_a_prefix_in_many_contexts(spark, group_size):
    r = random.Random(3)
    line = "one two three four five six seven eight"
    texts = [" ".join(f"{line} {r.choice(WORDS)} {r.choice(WORDS)}" for _ in range(60)) for _ in range(3)]
    texts += [f"{texts[0]} tail", f"head {texts[1][300:2600]}", " ".join([line] * 40), " ".join([line] * 30 + ["end"])]
    rows = list(enumerate(texts))
    h = substring_dedup.word_hashes(texts[5].encode().split())
    keys = substring_dedup.weighted_prefixes(h, 50, 8)
    assert len(keys) > len(set(keys.tolist())) and set(keys.tolist()) == set(substring_dedup.window_prefixes(h, 50, 8)[0].tolist())
    got = {x.doc_id: (x.n_words, x.n_removed, brute.sha(x.kept_text or "")) for x in substring_dedup.dedup_substrings(frame(spark, rows), group_size=group_size).collect()}
    assert got == brute.substring(rows, 50)


def test_substring_degenerate_inputs(spark):
    assert substring_dedup.dedup_substrings(empty(spark)).count() == 0
    t, u = " ".join(WORDS[:60]), " ".join(WORDS[100:160])
    rows = [(None, t), (4, t), (4, t), (6, t), (6, u), (8, f"{u} x"), (9, None)]
    got = sorted((r.doc_id or -1, r.n_words, r.n_removed) for r in substring_dedup.dedup_substrings(frame(spark, rows)).collect())
    assert got == [(-1, 60, 0), (4, 60, 0), (4, 60, 0), (6, 60, 0), (6, 60, 60), (8, 61, 60), (9, 0, 0)]


# ---- pipeline and registration ----
def test_pipeline_stages(spark):
    import corpus_pipeline as cp

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    seen = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in cp.STAGES[:4]:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = cp.write_shared(stage(spark, docs, d), "t").df
        assert docs.columns == list(cp.COLUMNS)
        after = {r.doc_id: r.text for r in docs.collect()}
        assert set(after) <= set(before)
        if name == "n-gram Jaccard join":
            groups = brute.jaccard_components(list(before.items()), 5, 80, 100)
            assert set(after) == {i for i, (_, c) in groups.items() if c == i}
        if name == "substring dedup":
            want = brute.substring(list(before.items()), 50)
            for i, text in before.items():
                if want[i][1] == 0:
                    assert after[i] == text
                else:
                    assert i not in after or brute.sha(after[i]) == want[i][2]
        if name == "benchmark decontamination":
            items = [tuple(r) for r in spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", "text").collect()]
            want = brute.contamination(list(before.items()), items, 10)
            assert set(after) == {i for i, w in want.items() if not w[4]}
    out = cp.STAGES[4][1](spark, docs, d).collect()
    e = tiktoken_encoder()
    assert {r.doc_id: bytes(r.ids) for r in out} == {i: brute.packed(e.encode_ordinary(t)) for i, t in after.items()}
    assert seen


def test_pipeline_stages_with_odd_rows(spark, tmp_path):
    import corpus_pipeline as cp

    shape = "doc_id long, text string, lang string, source string, n_chars long"
    base, other = " ".join(WORDS[:80]), " ".join(WORDS[100:180])
    rows = [(None, base), (1, base), (1, base), (2, base), (3, f"{other} tail words"), (None, f"{other} end"), (4, None), (5, ""), (6, f"x {other}"), (6, "short"), (None, None)]
    docs = spark.createDataFrame([(i, t, None if i == 3 else "en", "s", None if t is None else len(t)) for i, t in rows], shape)
    spark.createDataFrame([(1, 1, 0), (3, 1, 0), (None, 1, 0)], "doc_id long, quality long, toxic long").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "short"), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    stages = [f for _, f in cp.STAGES]
    show = lambda df: sorted((r.doc_id or 0, r.text or "") for r in df.collect())
    assert show(stages[0](spark, docs, str(tmp_path))) == sorted((i or 0, t or "") for i, t in rows)  # no held-out document: nothing is judged
    one = sorted((i or 0, t or "") for i, t in rows if i != 2 and not (i == 6))
    assert show(stages[1](spark, docs, str(tmp_path))) == one
    cut = show(stages[2](spark, docs, str(tmp_path)))
    assert cut == sorted((i or 0, "x" if t == f"x {other}" else t or "") for i, t in rows if i != 2)
    assert show(stages[3](spark, docs, str(tmp_path))) == sorted((i or 0, t or "") for i, t in rows if t != "short")
    assert stages[4](spark, docs, str(tmp_path)).where("n_tokens > 0").count() == sum(bool(t) for _, t in rows)
    assert cp.run(spark, str(tmp_path)).count() == len([i for i, t in rows if i not in (2, 6)])
    for stage in stages:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_every_operator_is_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names
    for n in range(1, 11):
        assert sum(bool(re.match(rf"op{n}_", x)) for x in names) == 1
