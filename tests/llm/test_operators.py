"""The operators against brute force on small tables, with nulls, empty and long texts, ties, repeated rows and empty tables."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerline.llm import ctw, decontaminate, factorization, html, langid, mixing, outliers, queries, sharding, simhash, substring

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, shard string, mix string"
WORDS = {"en": "the of and to in is that water river stone light morning".split(), "de": "der die und das nicht schule straße über können Haus".split()}


def sentence(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "", "x", "ing", "ung"]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = []
    for i in range(60):
        lang = "en" if i % 2 else "de"
        out.append([i, sentence(rng, lang, rng.randint(40, 90)), lang, f"s{i % 3}", 0, "a", "b", "c"])
    passage = sentence(rng, "en", 60)
    out += [[60, passage + " tail one", "en", "s0", 0, "a", "b", "c"], [61, "head " + passage, "en", None, 0, "a", "b", "c"]]
    out += [[70 + i, out[5][1], "en", "s0", 0, "a", "b", "c"] for i in range(8)]
    out += [[90, None, None, None, None, None, None, None], [91, "", "en", "s1", 0, "", "", ""], [None, out[7][1], "en", "s1", 0, "a", "b", "c"]]
    out += [out[3], out[3], [92, " \n\t ", "de", "s1", 0, "a", "b", "c"], [93, "word", "en", "s2", 0, "a", "b", "c"]]
    out += [[94, " ".join(f"w{i % 700}" for i in range(20000)), "en", "s2", 0, "a", "b", "c"]]
    return [tuple(r) for r in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def multiset(frame, *columns):
    return Counter(tuple(r) for r in frame.select(*columns).collect())


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_decontamination(spark, rows, docs, empty):
    def fold(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})))

    items = [(1, " ".join(split(rows[4][1])[5:30]).upper()), (2, None), (3, "..."), (4, "word"), (2, "no such words are here at all in any of them"), (None, rows[9][1]), (4, "word")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    want = Counter()
    for doc, text, *_ in rows:
        words, hit, found = fold(text), set(), set()
        for item, body in items:
            b = fold(body)
            k = min(10, len(b))
            for p in {tuple(b[i : i + k]) for i in range(len(b) - k + 1)} if k else ():
                for i in range(len(words) - k + 1):
                    if tuple(words[i : i + k]) == p:
                        hit |= set(range(i, i + k))
                        found |= set() if item is None else {str(item)}
        want[doc, len(words), len(hit), ",".join(sorted(found))] += 1
    for size in (decontaminate.BLOCK_BYTES, 200):  # one block of patterns, and several
        got = decontaminate.contamination(docs, bench, size).select("doc_id", F.col("found.n_words"), F.col("found.n_hit"), F.array_join("found.items", ","))
        assert multiset(got, "*") == want
    assert decontaminate.keep_clean(docs, bench).count() == sum(n for (_, _, hit, _), n in want.items() if not hit)
    assert decontaminate.contamination(empty, bench).count() == 0
    assert decontaminate.keep_clean(docs, bench.limit(0)).count() == len(rows)


def test_mixing(rows, docs, empty):
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(split(r[1]))
    names = sorted((s for s in sizes if s is not None)) + [None]
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, left, rest = {}, 1.5 * sum(sizes.values()), set(names)
    while True:
        total = sum(weights[s] for s in rest)
        over = {s for s in rest if left * weights[s] / total > 2 * sizes[s]}
        if not over:
            target |= {s: left * weights[s] / total for s in rest}
            break
        target |= {s: 2 * sizes[s] for s in over}
        left, rest = left - sum(2 * sizes[s] for s in over), rest - over
    planned = mixing.plan(docs)
    assert planned.columns[-1] == "_mix"
    got = planned.select("source", F.col("_mix.*")).distinct().collect()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], target[r["source"]])
        assert r["copies"] in (math.floor(r["target"] / r["source_size"]), math.ceil(r["target"] / r["source_size"]))
    assert multiset(mixing.plan(docs), "doc_id", "_mix.copies") == multiset(planned, "doc_id", "_mix.copies")
    assert mixing.mix(docs).count() == planned.agg(F.sum("_mix.copies")).first()[0]
    assert mixing.mix(docs).columns == docs.columns
    assert mixing.mix(empty).count() == 0


def test_sharding(docs, rows, empty):
    placed = sharding.assign(docs)
    assert placed.columns == [*docs.columns, "_shard"]
    got = placed.select("doc_id", "text", F.col("_shard.size").alias("n"), F.col("_shard.shard").alias("at"), F.col("_shard.slot").alias("slot")).collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter((r[0], r[1]) for r in rows)
    assert all(r["n"] == len((r["text"] or "").encode()) + 8 for r in got)
    for _, group in itertools.groupby(sorted(got, key=lambda r: r["at"]), key=lambda r: r["at"]):
        slots = sorted(r["slot"] for r in group)
        assert slots == list(range(len(slots)))
    assert sharding.assign(empty).count() == 0


def test_sharding_splits_hot_texts_evenly(spark):
    table = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot text").otherwise(F.concat(F.lit("t"), F.col("id"))).alias("text"))
    same = table.limit(1).crossJoin(spark.range(2000)).select("doc_id", "text")
    bytes_ = [r["b"] for r in sharding.assign(table.union(same)).groupBy("shard.shard").agg(F.sum("shard.size").alias("b")).collect()]
    assert len(bytes_) == sharding.SHARDS and max(bytes_) < 1.02 * min(bytes_)


def test_simhash(docs, rows, empty):
    def fingerprint(text):
        w = [x.decode() for x in (text or "").encode().lower().split()]
        shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = [(r[0], fingerprint(r[1])) for r in rows]
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(prints)), 2):
        if (prints[i][1] ^ prints[j][1]).bit_count() <= 2:
            root[find(j)] = find(i)
    smallest = {}
    for i, (doc, _) in enumerate(prints):
        if doc is not None:
            smallest[find(i)] = min(doc, smallest.get(find(i), doc))
    want = Counter((d, f"{p:016x}", smallest.get(find(i))) for i, (d, p) in enumerate(prints))
    assert multiset(simhash.near_duplicates(docs), "doc_id", "fingerprint", "component_id") == want
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len({find(i) for i in range(len(prints))})
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0


def test_links_of_crowded_lists_connect_as_all_pairs_do(spark):
    rng = random.Random(1)
    values = {0}
    for _ in range(300):
        x = rng.choice(sorted(values))
        for _ in range(rng.randint(1, 3)):
            x ^= 1 << rng.randrange(64)
        values.add(x)
    values = sorted(values)
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in itertools.combinations(values, 2):
        if (a ^ b).bit_count() <= 2:
            root[find(b)] = find(a)
    got = simhash.components(simhash.links(spark.createDataFrame([(simhash._signed(v),) for v in values], "fingerprint bigint")))
    groups = {}
    for r in got.collect():
        groups.setdefault(r["root"], set()).add(r["node"] % (1 << 64))
    want = {}
    for v in values:
        want.setdefault(find(v), set()).add(v)
    assert sorted(map(sorted, groups.values())) == sorted(sorted(g) for g in want.values() if len(g) > 1)


def test_substring(docs, rows, empty):
    window = substring.WINDOW
    split_rows = [(r[0], split(r[1])) for r in rows]
    found = Counter(tuple(w[i : i + window]) for _, w in split_rows for i in range(len(w) - window + 1))
    want = Counter()
    for doc, w in split_rows:
        gone = {j for i in range(len(w) - window + 1) if found[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        want[doc, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    for bucket in (substring.BUCKET, 500):  # one bucket, and several
        assert multiset(substring.dedup(docs, bucket=bucket), "doc_id", "n_words", "n_removed", "kept_sha256") == want
    assert substring.dedup(empty).count() == 0


def test_language(docs, rows, empty):
    training = docs.where("doc_id < 50")
    got = langid.identify(docs, training).select("doc_id", "lang", F.col("language.lang").alias("p"), "language.score", "language.rejected").collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r["score"] <= 1
        if r["doc_id"] in (90, 91, 92):
            assert r["p"] == "und" and r["rejected"]
        elif r["doc_id"] is not None and r["doc_id"] < 62:
            assert r["p"] == r["lang"] and not r["rejected"]
    assert langid.identify(empty, training).count() == 0
    assert {r["p"] for r in langid.identify(docs, empty).select(F.col("language.lang").alias("p")).collect()} == {"und"}


def _plain_tree(training, depth):
    """log10 probability of a text by a recursive context tree over the training texts; each text has one end."""
    counts = [{} for _ in range(depth + 1)]
    for t in training:
        s = b"\0" * depth + t + b"\0"
        for i in range(depth, len(s)):
            for d in range(depth + 1):
                counts[d].setdefault(s[i - d : i], Counter())[s[i]] += 1

    def bits(context, level, prefix):
        c = counts[len(context)].get(context, {})
        under = {b: n for b, n in c.items() if b >> (8 - level) == prefix}
        ones = sum(n for b, n in under.items() if b >> (7 - level) & 1)
        return sum(under.values()) - ones, ones

    def kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi) if a + b else 0.0

    def children(context, level, prefix):
        return sum(total(x, level, prefix) for x in counts[len(context) + 1] if x.endswith(context))

    def total(context, level, prefix):
        own = kt(*bits(context, level, prefix))
        if len(context) == depth:
            return own
        return math.log(math.exp(own) / 2 + math.exp(children(context, level, prefix)) / 2)

    def one(history, d, level, prefix):
        context = history[depth - d :]
        a, b = bits(context, level, prefix)
        estimate = (b + 0.5) / (a + b + 1)
        if d == depth or not sum(bits(history[depth - d - 1 :], level, prefix)):
            return estimate
        share = 1 / (1 + math.exp(children(context, level, prefix) - kt(a, b)))
        return share * estimate + (1 - share) * one(history, d + 1, level, prefix)

    def score(text):
        s, out = b"\0" * depth + text + b"\0", 0.0
        for i in range(depth, len(s)):
            for level in range(8):
                p = one(s[i - depth : i], 0, level, s[i] >> (8 - level))
                out += math.log10(p if s[i] >> (7 - level) & 1 else 1 - p)
        return out

    return score


@pytest.mark.parametrize("top, hot", [(2, 1 << 20), (0, 0), (1, 40)])
def test_tree_agrees_with_a_plain_one(docs, monkeypatch, top, hot):
    monkeypatch.setattr(ctw, "TOP", top)
    monkeypatch.setattr(ctw, "HOT_GRAMS", hot)
    texts = ["abracadabra", "abrab", "", None, "dab", "a\0b", "zz top", "", "abra", "abrab"]  # the last four are held out
    frame = docs.sparkSession.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, logp long")
    plain = [(t or "").replace("\0", "\1").encode() for t in texts]
    want = _plain_tree(plain[:6], 5)
    got = {r["doc_id"]: r["score"] for r in ctw.score(frame, F.col("doc_id") < 6).collect()}
    assert got == {i: pytest.approx(want(t), rel=1e-9) for i, t in enumerate(plain)}
    assert got[2] == got[3] == got[7]
    doubled = ctw.score(frame.union(frame.where("doc_id > 5")), F.col("doc_id") < 6).collect()
    assert Counter(r["doc_id"] for r in doubled) == Counter(list(range(6)) + [6, 7, 8, 9] * 2)
    assert all(r["score"] == pytest.approx(got[r["doc_id"]], rel=1e-9) for r in doubled)


def test_tree_without_training(docs, monkeypatch):
    frame = docs.sparkSession.createDataFrame([(1, "abc"), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in ctw.score(frame, F.lit(False)).collect()}
    assert got == {1: pytest.approx(4 * math.log10(1 / 256)), 2: pytest.approx(math.log10(1 / 256))}


def test_long_texts_are_cut_with_their_context():
    texts = [b"abcdefghij" * 3, b"", b"xy", b"q" * 17]
    whole, cut = ([(c.tolist(), o.tolist()) for c, o in ctw.gram_codes(texts, chunk)] for chunk in (1000, 7))
    assert len(whole) == 1 and len(cut) > 5
    assert [sum((x[i] for x in cut), []) for i in (0, 1)] == list(whole[0])


def test_hot_codes_are_found():
    codes = np.unique(np.random.default_rng(5).integers(0, 1 << 48, 5000))
    hot = ctw._Hot(codes[::2], np.arange(len(codes[::2]), dtype=float))
    place = hot.places(codes)
    assert (place[1::2] == 0).all() and (hot.logs[place[::2]] == np.arange(len(codes[::2]))).all()
    assert (ctw._Hot(codes[:0], np.zeros(0)).places(codes) == 0).all()


def test_scores(docs, rows, empty):
    training = F.coalesce(F.col("doc_id"), F.lit(0)) % 10 != 0
    got = ctw.score(docs, training).collect()
    seen = Counter(w for r in rows if (r[0] or 0) % 10 for w in [*(x.decode() for x in (r[1] or "").encode().lower().split()), "\n"])
    n, v = sum(seen.values()), len(seen)
    want = Counter()
    for r in rows:
        words = [*(x.decode() for x in (r[1] or "").encode().lower().split()), "\n"]
        want[r[0], len(words), sum(w in seen for w in words), round(sum(math.log10((seen[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words), 5)] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 5)) for r in got) == want
    assert all(r["train_tokens"] == n and math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert ctw.score(empty, training).count() == 0


def test_rare_tokens_are_joined(docs, monkeypatch):
    training = F.coalesce(F.col("doc_id"), F.lit(0)) % 10 != 0
    columns = ("doc_id", "n_known", F.round("base_score", 5))
    with_hot = multiset(ctw.score(docs, training), *columns)
    monkeypatch.setattr(ctw, "HOT", 20)
    assert multiset(ctw.score(docs, training), *columns) == with_hot


def test_quality_rules(docs, rows, empty):
    got = outliers.judge(docs).collect()
    want = Counter()
    for r in rows:
        text = r[1] or ""
        w = split(text)
        windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        covered = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
        lines = [x for x in text.split("\n") if split(x)]
        want[r[0], len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)] += 1
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got) == want
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    assert outliers.judge(empty).count() == 0


def test_outliers_are_rejected(spark):
    rng = random.Random(5)
    good = [(i, sentence(rng, "en", 80), "en", "s") for i in range(200)]
    bad = [(1000 + i, " ".join(x + "###" for x in split(sentence(rng, "en", 80))), "en", "s") for i in range(30)]
    got = {r["doc_id"]: r["kept"] for r in outliers.judge(spark.createDataFrame(good + bad, "doc_id bigint, text string, lang string, source string")).collect() if not r["base_failed"]}
    assert not any(v for k, v in got.items() if k >= 1000)
    assert sum(v for k, v in got.items() if k < 1000) >= 0.98 * sum(k < 1000 for k in got)


def test_a_third_of_copies_of_one_outlier_is_rejected(spark):
    rng = random.Random(7)
    spam = " ".join(x + "###" for x in split(sentence(rng, "en", 80)))
    rows = [(i, sentence(rng, "en", 80), "en", "s") for i in range(200)] + [(1000 + i, spam, "en", "s") for i in range(100)]
    got = {r["doc_id"]: r["kept"] for r in outliers.judge(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")).collect() if not r["base_failed"]}
    assert sum(k >= 1000 for k in got) == 100 and not any(v for k, v in got.items() if k >= 1000)
    assert sum(v for k, v in got.items() if k < 1000) >= 0.95 * sum(k < 1000 for k in got)


def test_each_coordinate_alone_can_reject(spark):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(4000)]

    def text(words):
        return "\n".join(" ".join(words[i : i + 10]) for i in range(0, len(words), 10))

    def plain(n=200):
        return rng.sample(vocabulary, n)

    lines = [rng.sample(vocabulary, 2) for _ in range(100)]
    odd = {
        "word_length": text([x * 4 for x in plain()]),
        "symbols": text([x + "#" if i % 4 == 0 else x for i, x in enumerate(plain())]),
        "dup_lines": "\n".join(" ".join(x) for x in [*lines, *rng.sample(lines, 80)]),
        "repeats": text([*(twice := plain(45)), *plain(110), *twice]),
        "upper": text([x.upper() if i % 3 == 0 else x for i, x in enumerate(plain())]),
        "distinct": text([x for pair in zip(plain(100), ["same"] * 100) for x in pair]),
    }
    rows = [(i, text(plain()), "en", "s") for i in range(300)] + [(1000 + i, x, "en", "s") for i, x in enumerate(odd.values())]
    got = {r["doc_id"]: r for r in outliers.judge(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")).collect()}
    assert not any(r["base_failed"] for r in got.values())
    assert [name for i, name in enumerate(odd) if got[1000 + i]["kept"]] == []
    assert sum(r["kept"] for k, r in got.items() if k < 1000) >= 0.97 * 300


def test_quality_scores(spark, docs, rows, empty):
    rng = random.Random(6)
    texts = [(i, sentence(rng, "en", 40) if i % 2 else sentence(rng, "en", 40).upper().replace(" ", "!! ")) for i in range(300)]
    table = spark.createDataFrame(texts, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)] + [(None, 1), (3, None), (5, 1)], "doc_id bigint, quality int")
    held = F.col("doc_id") % 3 == 1
    got = factorization.score(table.where(held), table.where(~held), labels).collect()
    assert all((r["quality_score"] >= 0.5) == bool(r["doc_id"] % 2) for r in got)
    assert all(0 <= r["quality_score"] <= 1 for r in factorization.score(docs, table, labels).collect())
    assert {r["quality_score"] for r in factorization.score(docs, table, labels.limit(0)).collect()} == {0.5}
    assert factorization.score(empty, table, labels).count() == 0


def test_interactions_equal_the_sum_over_pairs():
    import numpy as np

    rng = np.random.default_rng(0)
    machine = factorization.Machine(0.1, rng.normal(size=factorization.DIMENSIONS), rng.normal(size=(factorization.DIMENSIONS, 8)) / 4, np.zeros(factorization.STATISTICS), np.ones(factorization.STATISTICS))
    numbers, values = factorization.features(b"some Words and some more", factorization._Slots())
    x = machine.standardise(values)
    z = machine.bias + machine.linear[numbers] @ x + sum(machine.factors[numbers[i]] @ machine.factors[numbers[j]] * x[i] * x[j] for i, j in itertools.combinations(range(len(x)), 2))
    assert machine.score(numbers, values) == pytest.approx(1 / (1 + math.exp(-max(-50, min(50, z)))))


PAGE = """<html><head><title>T</title><style>p{}</style></head><body class="nav-open"><header>Site</header><nav><a href=x>Menu</a></nav>
<aside>Side</aside><div class="cookie-notice">We use cookies</div><!-- no <p>text</p> --><div id=main><article><h1>Head &amp; line</h1>
<p>First   paragraph of the text with <b>bold
words and <a href=y>one link</a> in it, long enough to count.<br>After a break.<p>Second &lt;paragraph&gt; that is long enough as well, I think.
<ul><li>An item of the list<li>Another item</ul><div class="ad">Buy</div></article><section class="comments"><p>Nice post, thanks a lot for it</p></section></div>
<form><p>Name</p></form><script>var t="</p><p>code</p>";</script><footer>&copy; me</footer>"""


def test_html(spark):
    want = "Head & line\n\nFirst paragraph of the text with bold words and one link in it, long enough to count. After a break.\n\nSecond <paragraph> that is long enough as well, I think.\n\nAn item of the list\n\nAnother item"
    pages = spark.createDataFrame([(1, PAGE), (1, PAGE), (2, None), (3, ""), (4, "plain & text"), (5, "<p>" * 5000 + "deep"), (6, "<nav>only</nav>")], "main_text bigint, html string")
    got = html.extract(pages)
    assert got.columns == ["main_text", "html", "_main_text"]
    assert Counter((r[0], r[2]) for r in got.collect()) == Counter([(1, want), (1, want), (2, ""), (3, ""), (4, "plain & text"), (5, "deep"), (6, "")])
    assert html.extract(pages.limit(0)).count() == 0


def test_html_parsing_of_broken_and_nested_markup():
    cases = {
        "<div>" * 20_000 + "deep": "deep",
        "<a " * 20_000: " ".join(["<a"] * 20_000),
        "<" + "a" * 100_000: "<" + "a" * 100_000,
        "<p>seen</p><!-- never > ended": "seen",
        "<p>seen</p> tail <!-- never ended": "seen\n\ntail",
        "<p>one <span class=ad>x <span>y</span> z</span> two</p>": "one two",
        "<article><figure><img src=x><figcaption>Caption</figcaption></figure><p>Body of it</p></article>": "Caption\n\nBody of it",
        "<p title='a > b'>text</p>": "text",
    }
    assert [html.main_text(page) for page in cases] == list(cases.values())


def test_html_keeps_all_sections_of_an_article():
    def section(n, c):
        return "".join(f"<p>{c * 300}</p>" for _ in range(n))

    def lines(n, c):
        return [c * 300] * n

    links = "<ul>" + "<li><a href=x>Another page of it</a></li>" * 9 + "</ul>"
    unequal = f"<h2>Intro</h2><div>{section(20, 'a')}</div><h2>Method</h2><div>{section(5, 'b')}</div>"
    text = ["Intro", *lines(20, "a"), "Method", *lines(5, "b")]
    cases = {
        f"<body><div>{unequal}</div></body>": text,
        f"<body>{unequal}</body>": text,
        f"<body><div>{links}</div><div>{unequal}</div></body>": text,
        f"<body><article>Lead text <b>here</b><div>{section(9, 'c')}</div>Last words<div><p>short</p></div></article></body>": ["Lead text here", *lines(9, "c"), "Last words", "short"],
    }
    assert [html.main_text(page).split("\n\n") for page in cases] == list(cases.values())


def test_html_wrappers_and_attributes_do_not_hide_an_article():
    body = "<h1>Head</h1>" + "<p>A paragraph of some length, for the article.</p>" * 8
    want = ["Head"] + ["A paragraph of some length, for the article."] * 8
    side = "<div class='nav-links'><p>Go on</p></div>"
    wrappers = ['style="overflow:hidden"', 'title="hidden costs"', "title='a class=menu'", 'data-id="menu"', 'data-role="form"', 'class="site has-sidebar"', "class=no-sidebar", 'class="elementor-widget elementor-widget-text-editor"']
    wrappers += ['id="search-result-article"', 'class="social-sciences"', "class=navy", 'class="widget"', "id=banner class=x"]
    for attributes in wrappers:
        assert html.main_text(f"<body>{side}<div {attributes}>{body}</div></body>").split("\n\n") == want, attributes
        assert html.main_text(f"<body>{side}<article>{body}<div {attributes}><p>Part of it</p></div></article></body>").split("\n\n")[: len(want)] == want
    for attributes in wrappers[:11]:
        assert html.main_text(f"<body><article>{body}<div {attributes}><p>Part of it</p></div></article></body>").split("\n\n") == [*want, "Part of it"], attributes
    for attributes in ("hidden", 'class="x site-footer"', "class='ad'", "id=main-nav", "role=navigation", 'aria-hidden="true"', 'class="comment-list"', 'class="widget-area"'):
        assert html.main_text(f"<body><div {attributes}><p>Beside it</p></div><article>{body}</article></body>").split("\n\n") == want, attributes
    assert html.main_text(f"<form id=aspnet>{body}<input name=x></form>").split("\n\n") == want
    assert html.main_text("<article><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be</p><svg><path d='M0'/><text>Label</text></svg><p>tail</p></article>").split("\n\n") == ["Let x=1 be", "Label", "tail"]


def test_copies_do_not_crowd_the_sample(spark, rows):
    copies = spark.range(5000).select(F.lit(sentence(random.Random(9), "en", 60)).alias("text"), F.lit("en").alias("lang"))
    others = spark.createDataFrame([(r[1], r[2]) for r in rows[:60]], "text string, lang string")
    model = langid.fit(copies.union(others))
    assert set(model.languages) == {"en", "de"}
    assert [p["lang"] for p in model.predict(pa.array([r[1] for r in rows[:20]]))] == [r[2] for r in rows[:20]]


def test_a_language_of_few_texts_with_many_copies_is_learned(spark, rows):
    few = [r[1] for r in rows[:60] if r[2] == "de"][:3]
    copies = spark.range(9000).select(F.element_at(F.array(*map(F.lit, few)), (F.col("id") % 3 + 1).cast("int")).alias("text"), F.lit("de").alias("lang"))
    others = spark.createDataFrame([(r[1], r[2]) for r in rows[:60] if r[2] == "en"], "text string, lang string")
    model = langid.fit(copies.union(others))
    assert model.languages.count("de") == 3 and "en" in model.languages
    assert [(p["lang"], p["rejected"]) for p in model.predict(pa.array(few))] == [("de", False)] * 3


def test_pipeline(spark, docs, tmp_path):
    docs.drop("size", "shard", "mix").write.parquet(f"{tmp_path}/documents.parquet")
    passage = docs.where("doc_id = 10").first()["text"]
    spark.createDataFrame([(1, passage)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, at, str(tmp_path))
        assert out.columns == at.columns
        out.write.parquet(f"{tmp_path}/{name}")
        at = spark.read.parquet(f"{tmp_path}/{name}")
        ids = {r["doc_id"] for r in at.select("doc_id").collect()}
        assert 90 not in ids
        if name in ("near_dedup", "decontamination"):
            assert ids & {5, *range(70, 78)} == {5}
        if name == "decontamination":
            assert 10 not in ids
    result = corpus_pipeline.run(spark, str(tmp_path))
    assert result.count() == at.count() and {"shard", "slot", "size"} <= set(result.columns)


def test_registered_queries_have_the_columns_of_their_contract(spark, sf_dir):
    want = {
        "op3_extract_html": ["page_id", "url", "text", "n_chars"],
        "op4_language_id": ["doc_id", "held_out", "lang_pred", "score"],
        "op5_shard": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
        "op6_quality": ["doc_id", "held_out", "score", "predicted"],
    }
    for name, columns in want.items():
        assert queries.QUERIES[name](spark, sf_dir).columns[: len(columns)] == columns
