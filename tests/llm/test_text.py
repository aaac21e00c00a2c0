import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanflow.llm import common, language, licenses, media, mixing, packing, quality


def test_quality_held_out(spark, sample, docs, empty):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    model = quality.train_quality(sample, labels)
    got = quality.score_quality(sample, model).join(labels, "doc_id").collect()
    assert sum(r.predicted == r.quality for r in got) >= 0.9 * len(got)
    held = {r.doc_id: r.held_out for r in quality.quality_scores(sample, labels).collect()}
    assert all(v == (zlib.crc32(str(k).encode()) % 5 == 0) for k, v in held.items())
    odd = quality.quality_scores(docs, labels.limit(0)).collect()
    assert len(odd) == 12 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in odd)
    assert quality.quality_scores(empty, labels).count() == 0


def test_quality_logits_equal_the_mean_of_vectors():
    rows = [(0, 1, "good words in a row"), (1, 0, "$$$ %%% !!!"), (2, 1, "more good words"), (3, 0, "!! !! !!")]
    model = quality.SubwordModel.train(rows)
    texts = ["", "a", "good good !!", "words  and\n$$$ words"]
    for text, z in zip(texts, model.logits(texts), strict=True):
        slots, count = quality.tokens_of(text)
        mean = (count / max(1, count.sum())) @ model.vectors[slots] if len(slots) else np.zeros(quality.DIM)
        own = mean @ model.weights + model.bias
        assert np.isclose(z[1] - z[0], own[1] - own[0], atol=1e-4)


def test_media_round_trip(spark, docs):
    df = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("payload"), F.lit(1).alias("wav"))
    for r, t in zip(media.fingerprint(df).orderBy("doc_id").collect(), docs.orderBy("doc_id").collect(), strict=True):
        raw = (t.text or "").encode()
        raw = raw.ljust(max(1, -(-len(raw) // 192)) * 192)
        assert bytes(r.pcm) == raw and media.wav_samples(bytes(r.wav)) == raw
        assert r.pair_time == sorted(r.pair_time) and len(r.pair_time) == len(r.pair_code)
        times, pairs = media.peak_pairs(np.frombuffer(raw, np.uint8))
        assert times.tolist() == r.pair_time and pairs.tolist() == r.pair_code


def test_cross_parsing_against_substring_search():
    samples = {"a": "the cat sat on the mat and the dog", "b": "le chat est sur le tapis et la"}
    model = language.CrossParser(samples)
    text = "the tapis sat est xylophone dog"
    plain = language._plain(text)
    for k, name in enumerate(model.languages):
        source, i, n = language._plain(samples[name]), 0, 0
        while i < len(plain):
            j = i + 1
            while j <= len(plain) and plain[i:j] in source:
                j += 1
            i, n = max(i + 1, j - 1), n + 1
        assert model.phrases([text])[0][0, k] == n


def test_letters_beyond_the_table_are_letters():
    rng = np.random.default_rng(0)
    word = lambda lo: "".join(chr(x) for x in rng.integers(lo, lo + 1500, 2))
    words = {"x": [word(0x4E00) for _ in range(300)], "y": [word(0x5200) for _ in range(300)]}  # scripts that share letters
    text = lambda k, n: " ".join(rng.choice(words[k], n))
    model = language.CrossParser({k: text(k, 4000) for k in words} | {"z": "plain words of few letters " * 50})
    assert model.unknown > 900 > model.dense
    got = model.predict([text("x", 20), text("y", 20), "words of letters", "\U00031350\U00031351", "12 --"])[0]
    assert got[:3] == ["x", "y", "z"] and got[3] != "und" and got[4] == "und"
    source = language._plain("".join(words["x"][:50]))
    small = language.CrossParser({"x": source})
    asked = language._plain(text("x", 30))
    i = n = 0
    while i < len(asked):
        j = i + 1
        while j <= len(asked) and asked[i:j] in source:
            j += 1
        i, n = max(i + 1, j - 1), n + 1
    assert small.phrases([asked])[0][0, 0] == n


def test_language(sample, docs, empty):
    got = language.identify_language(sample, language.train_language(sample)).join(sample.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in got) >= 0.95 * len(got)
    odd = {r.doc_id: r for r in language.identify_language(docs, language.train_language(docs)).collect()}
    assert odd[2].lang_pred == odd[3].lang_pred == odd[4].lang_pred == "und" and odd[1].lang_pred == "en"
    assert language.identify_language(empty, language.train_language(empty)).count() == 0


def test_license_versions_written_with_v(spark):
    names = {"apache-2": "Apache License {}2.0", "apache-1.1": "Apache Software License {}1.1", "agpl-3.0": "GNU Affero General Public License {}3", "agpl-1.0": "Affero General Public License {}1", "lgpl-3.0": "GNU Lesser General Public License {}3.0", "lgpl-2.1": "Lesser General Public License {}2.1", "lgpl-2.0": "Library General Public License {}2", "gpl-3.0": "GNU General Public License {}3", "gpl-2.0": "General Public License {}2.0", "gpl-1.0": "General Public License {}1", "gfdl-1.3": "GNU Free Documentation License {}1.3", "gfdl-1.2": "Free Documentation License {}1.2", "mpl-2.0": "Mozilla Public License {}2.0", "mpl-1.1": "Mozilla Public License {}1.1", "epl-2.0": "Eclipse Public License {}2.0", "epl-1.0": "Eclipse Public License {}1.0", "artistic-2.0": "Artistic License {}2.0"}
    made = [(name.format(v), label) for label, name in names.items() for v in ("", "v", "V ", "version ")] + [("MPLv2", "mpl-2.0"), ("LGPL v2.1", "lgpl-2.1"), ("AGPLv3", "agpl-3.0")]
    df = spark.createDataFrame([(i, f"Released under the {x}.") for i, (x, _) in enumerate(made)], "doc_id long, text string")
    got = {r.doc_id: r.labels for r in licenses.scan_licenses(df).collect()}
    assert [(x, got[i]) for i, (x, _) in enumerate(made)] == made


def test_license_base_against_brute_force(spark, sample, docs, empty):
    made = [(1, "Under the MIT License, under THE mit  license!"), (2, "xunder the mit license"), (3, "Apache License, Version 2.0 and CC-BY-NC 4.0"), (4, "under the mit licenses"), (5, None), (6, "K under the mit license"), (7, "SPDX-License-Identifier: GPL v3 or later")]
    df = spark.createDataFrame(made, "doc_id long, text string").unionAll(sample.select(F.col("doc_id") + 100, "text")).unionAll(docs.select(F.col("doc_id") + 9000, "text"))
    texts = df.collect()
    got = {(r.doc_id): r for r in licenses.scan_licenses(df).collect()}
    for r in texts:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
        at, names = [], set()
        for phrase, label in licenses.BASE:
            p = phrase.split()
            here = [i for i in range(len(w)) if w[i] == p[0] and w[i : i + len(p)] == p]
            at, names = at + here, names | ({label} if here else set())
        g = got[r.doc_id]
        assert (g.n_words, g.n_base, g.first_word, g.last_word, g.base_labels) == (len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(names)))
        assert names <= {*g.labels.split(",")}
    assert got[7].labels == "gpl-3.0" and got[7].score == 1.0 and len(licenses.rules()) > 300
    assert [d.label for d in got[3].detections] == ["apache-2", "cc-by-nc"]
    assert licenses.scan_licenses(empty).count() == 0


def scanned(text):
    """Detections (start, end, label, rule) by a plain scan: every rule on every text, no keywords, no gate."""
    norm = re.sub(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ", f" {text or ''} ".lower())
    found = []
    for number, _, label, priority, _, regex in licenses.rules():
        for m in re.finditer(regex, norm):
            at = norm[: m.start()].count(" ")
            found.append((at, at + m[0].count(" "), priority, number, label))
    inside = lambda a, b: b[0] <= a[0] and a[1] <= b[1] and ((b[1] - b[0]) > (a[1] - a[0]) or b[2:4] < a[2:4])
    return sorted((a[0], a[1], a[4], a[3]) for a in found if not any(inside(a, b) for b in found))


def example(expression, rng=None):
    """A text that an expression matches. Without rng: the first branch of each choice, the first sign of each class, optional
    parts left out; else all of these by chance."""
    import re._constants as c
    import re._parser as parser

    def one(parts):
        out = ""
        for op, arg in parts:
            if op is c.LITERAL:
                out += chr(arg)
            elif op is c.IN:
                kind, value = rng.choice(arg) if rng else arg[0]
                out += "0" if kind is c.CATEGORY else chr(value if kind is c.LITERAL else value[0])
            elif op is c.BRANCH:
                out += one(rng.choice(arg[1]) if rng else arg[1][0])
            elif op is c.SUBPATTERN:
                out += one(arg[3])
            elif op is c.MAX_REPEAT:
                low, high = arg[0], min(arg[1], arg[0] + 2)
                out += "".join(one(arg[2]) for _ in range(rng.randint(low, high) if rng else low))
        return out

    return one(parser.parse(expression))


def test_keywords_stand_in_all_that_their_rules_match():
    """No spelling of a rule is kept from it by its keyword or by the gate."""
    rng = random.Random(8)
    for number, keyword, *_, expression in licenses.rules():
        for _ in range(60):
            text = example(expression, rng) + " "
            assert re.search(expression, text) and keyword in text and any(a in text for a in licenses.ANCHORS), (number, text)


def test_british_spellings(spark):
    names = {"PHP licence 3.01": "php-3.01", "the Elastic licence 2.0": "elastic-2.0", "PSF licence": "python-2.0", "Open Software Licence 3.0": "osl-3.0", "Community Data Licence Agreement Permissive 2.0": "cdla-permissive-2.0"}
    df = spark.createDataFrame([(i, f"x {k} y") for i, k in enumerate(names)], "doc_id long, text string")
    assert [r.labels for r in licenses.scan_licenses(df).orderBy("doc_id").collect()] == [*names.values()]


def test_detections_against_a_plain_scan(spark, sample):
    rules = licenses.rules()
    assert len(licenses.NOTICES) + len(licenses.FAMILIES) >= 170 and len({r[5] for r in rules}) == len(rules)
    own = [f"x {example(r[5])} y" for r in rules]  # every rule is tried and found
    mixed = [" and ".join(own[k : k + 4]).upper() for k in range(0, len(own), 7)] + [f"({'; '.join(own[k::60])})" for k in range(20)]
    texts = own + mixed + [r.text for r in sample.limit(100).collect()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: sorted((d.start, d.end, d.label, d.rule) for d in r.detections) for r in licenses.scan_licenses(df).collect()}
    for i, text in enumerate(texts):
        assert got[i] == scanned(text), text[:200]
    assert all(any(a <= 1 and e > 1 for a, e, *_ in got[i]) for i in range(len(own)))


def test_suppression_keeps_the_wider(spark):
    df = spark.createDataFrame([(1, "released under the GNU Affero General Public License version 3")], "doc_id long, text string")
    r = licenses.scan_licenses(df).first()
    assert r.labels == "agpl-3.0" and len(r.detections) == 1


def check_packing(rows, texts, window):
    import public_tokenizers
    from tokenizers import Tokenizer

    bpe = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = [[*e.ids, 0] for e in bpe.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert sum(r.length for r in rows) == sum(map(len, ids))
    whole = {}
    for r in sorted(rows, key=lambda r: r.start):
        whole.setdefault(r.doc_id, {}).setdefault(r.start, bytes(r.ids))
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append(r)
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= window
    return ids, sequences


def test_packing(sample, docs, empty):
    rows, texts = packing.pack(sample).collect(), sample.collect()
    ids, sequences = check_packing(rows, [r.text for r in texts], 1024)
    assert len(sequences) <= sum(map(len, ids)) / 1024 + 8
    want = {r.doc_id: x for r, x in zip(texts, ids, strict=True)}
    for r in rows:
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == want[r.doc_id][r.start : r.start + r.length]
    odd = packing.pack(docs, 64).collect()
    check_packing(odd, [r.text for r in docs.collect()], 64)
    assert packing.pack(empty).count() == 0


def test_packing_of_the_vocabularys_marker(spark):
    """A marker in a text is the marker's id, as the tokenizer has it by default."""
    texts = ["a<|endoftext|>b", "<|endoftext|>", "<|endoftext|><|endoftext|> it's é <|endoftext|>", "<|endoftext| >", "plain"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ids, _ = check_packing(packing.pack(df, 16).collect(), texts, 16)
    assert [x.count(50256) for x in ids] == [1, 1, 3, 0, 0]


def bm25(docs, idf, mean, query, i):
    n = {t: docs[i].count(t) for t in {*docs[query]} & {*docs[i]}}
    return sum(idf[t] * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(docs[i]) / mean)) for t, c in n.items())


def test_windows_are_filled_by_the_best_unused_neighbours(spark):
    """The same sequences as a plain greedy fill that scores every pair by the formula."""
    rng = np.random.default_rng(5)
    words = [f"w{x}" for x in range(60)]
    rows = [(i, " ".join(rng.choice(words, rng.integers(1, 40)))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = packing.pack(df, 64).collect()
    ids = {i: packing.encoder(None).encode([t])[0].tolist() + [0] for i, t in rows}
    n = Counter(t for x in ids.values() for t in {*x})
    idf = defaultdict(float, {t: max(0.0, np.log((60 - c + 0.5) / (c + 0.5))) for t, c in n.items()})
    mean = sum(map(len, ids.values())) / 60
    counts = np.zeros(1 << 16)
    counts[[*n]] = [*n.values()]
    draw = packing.draws(counts, 60)
    luck = {r.doc_id: r.h for r in df.select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    order = sorted(ids, key=lambda i: (packing.content_key(np.array(ids[i]), draw), luck[i]))
    assert df.sparkSession.conf.get("spark.sql.shuffle.partitions") == "4"
    whole, want = [], []
    docs = [ids[i] for i in order]
    left = {k: len(x) % 64 for k, x in enumerate(docs) if len(x) % 64}
    window, used, seed = [], 64, None
    while left:
        ranked = sorted(left, key=lambda k: (-round(bm25(docs, idf, mean, seed, k), 4), k)) if seed is not None else [min(left)]
        for k in ranked:
            if used == 64:
                want.append(window := [])
                used, seed = 0, k
            rest, size = left.pop(k), 0
            size = min(rest, 64 - used)
            window.append((order[k], size))
            used, seed = used + size, k if seed is None else seed
            if size < rest:
                want.append(window := [(order[k], rest - size)])
                used, seed = rest - size, k
                break
            if used == 64:
                seed = None
                break
    sequences = defaultdict(list)
    for r in sorted(got, key=lambda r: r.offset):
        sequences[r.sequence_id].append((r.doc_id, r.length))
    whole = [x for x in sequences.values() if x[0][1] == 64 and len(x) == 1]
    assert sorted([*want, *(x for x in whole if x not in want)]) == sorted(sequences.values())


def test_neighbours_beat_file_order(spark):
    docs = common.tune(spark).read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").orderBy("doc_id").coalesce(1)
    rows = packing.pack(docs).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    ids = dict(zip(texts, (x.tolist() for x in packing.encoder(None).encode([*texts.values()])), strict=True))
    n = Counter(t for x in ids.values() for t in {*x})
    idf = {t: max(0.0, np.log((1000 - c + 0.5) / (c + 0.5))) for t, c in n.items()}
    mean = sum(map(len, ids.values())) / len(ids)
    sequences = defaultdict(list)
    for r in sorted(rows, key=lambda r: r.offset):
        sequences[r.sequence_id].append(r.doc_id)
    pairs = [(x[0], y) for x in sequences.values() for y in x[1:]]
    names = sorted(ids)
    score = lambda found: np.mean([bm25(ids, idf, mean, a, b) for a, b in found])
    assert score(pairs[:400]) > 1.3 * score(list(zip(names, names[1:]))[:400])


def test_rows_of_a_content_are_neighbours():
    """Weighted samples agree as often as the weights of two rows' terms overlap."""
    rng = np.random.default_rng(1)
    df = rng.integers(1, 400, 1 << 16)
    a = rng.choice(1 << 16, 300, False)
    b = np.concatenate((a[:200], rng.choice(1 << 16, 100, False)))
    same = 0
    for seed in range(300):
        draw = packing.draws(df, 1000, seed)
        same += (packing.content_key(a, draw) + (1 << 63)) >> 48 == (packing.content_key(b, draw) + (1 << 63)) >> 48
    weight = np.where(df >= 5, np.maximum(0, np.log((1000 - df + 0.5) / (df + 0.5))) ** 2, 0)
    overlap = weight[np.intersect1d(a, b)].sum() / weight[np.union1d(a, b)].sum()
    assert abs(same / 300 - overlap) < 0.1


def test_index_scores_against_the_formula():
    docs = [np.array(x, np.uint16) for x in ([1, 2, 2, 3], [2, 3, 4], [5, 6])]
    idf = np.zeros(1 << 16, np.float32)
    idf[1:7] = [1, 2, 3, 4, 5, 6]
    got = packing.Shard(docs, idf, 3.0).scores(0)
    for i, d in enumerate(docs):
        s = 0.0
        for t in {1, 2, 3}:
            n = (d == t).sum()
            s += idf[t] * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(d) / 3)) if n else 0
        assert np.isclose(got[i], s)


def test_mixing_meets_small_targets(spark):
    """A domain with a share of 0.00002 and a target of 0.0001 gets its target, to a hundredth."""
    rows = [(10**5, [1.0, 0.0, 0.0])] * 30 + [(10**5, [0.0, 1.0, 0.0])] * 20 + [(20, [0.0, 0.0, 1.0])] * 5
    df = spark.createDataFrame(rows, "n_tokens long, posteriors array<double>")
    rated, fit = mixing.fit_rates(df, {"a": 0.5, "b": 0.4999, "c": 0.0001}, ["a", "b", "c"], 1.0, 0.0)
    got = rated.agg(*(F.sum(F.col("n_tokens") * F.col("rate") * F.col("posteriors")[i]).alias(f"t{i}") for i in range(3))).first()
    assert fit.converged and all(abs(got[i] / 5000100 - w) <= min(1e-4, 0.01 * w) * 1.0001 for i, w in enumerate((0.5, 0.4999, 0.0001)))


def test_mixing_reaches_targets(sample, docs, empty):
    want = {"en": 0.4, "fr": 0.3, "de": 0.2, "es": 0.1}
    rows = mixing.mix(sample, sample.select("doc_id", "lang"), "lang", want).collect()
    names = sorted(want)
    totals = np.array([r.rate * r.n_tokens * np.array(r.posteriors) for r in rows]).sum(0)
    assert np.allclose(totals / sum(r.n_tokens for r in rows), [want[k] for k in names], atol=1e-3)
    assert all(r.rate >= 0 and abs(r.copies - r.rate) < 1 for r in rows)
    more = mixing.mix(sample, sample.select("doc_id", "lang"), "lang", budget=None, least=1.0)
    assert more.where("copies < 1").count() == 0
    again = mixing.mix_rows(sample.withColumn("copies", F.lit("mine")), sample.select("doc_id", "lang"), "lang", budget=None, least=1.0)
    assert again.columns == [*sample.columns, "copies"] and again.where("copies <> 'mine' or rate <> 'x'").count() == 0
    assert again.select("doc_id").distinct().count() == sample.count()
    assert mixing.mix(docs, docs.select("doc_id", "lang"), "lang").count() == 12
    assert mixing.mix(empty, empty.select("doc_id", "lang"), "lang").count() == 0
    for kind in ("int", "string"):  # labels that look like classes of another model
        numbers = sample.select("doc_id", (F.col("lang") == "en").cast("int").cast(kind).alias("y"))
        got = mixing.mix(sample, numbers, "y", {0: 0.7, 1: 0.3})
        assert {r.domain for r in got.collect()} == {"0", "1"} and got.agg(F.sum("copies")).first()[0] > 150
    with pytest.raises(ValueError, match="xx"):
        mixing.mix(sample, sample.select("doc_id", "lang"), "lang", {"en": 1, "xx": 1})
    with pytest.raises(ValueError, match="values"):
        mixing.train_domains(sample, sample.select("doc_id", "lang"), "lang", max_domains=3)
    with pytest.raises(mixing.NotConverged):
        mixing.mix(sample, sample.select("doc_id", "lang"), "lang", want, max_steps=1)


@pytest.mark.parametrize("least,budget", [(0.0, 1.0), (1.0, 1.0), (0.5, 1.2)])
def test_rates_against_plain_projected_gradient(spark, least, budget):
    rng = np.random.default_rng(4)
    p, t = rng.dirichlet([0.4] * 3, 60), rng.integers(0, 50, 60)
    df = spark.createDataFrame([(i, int(n), x.tolist()) for i, (n, x) in enumerate(zip(t, p, strict=True))], "doc_id long, n_tokens long, posteriors array<double>")
    rated, fit = mixing.fit_rates(df, {"a": 0.6, "b": 0.3, "c": 0.1}, ["a", "b", "c"], budget, least, close=1e-7, flat=1e-7, max_steps=3000)
    share, target = t @ p / t.sum(), np.array([0.6, 0.3, 0.1]) * budget
    r = np.full(60, max(1.0, least))
    for _ in range(60000):
        r = np.maximum(least, r - p @ ((t * r @ p / t.sum() - target) / share))
    squares = lambda x: (((t * x @ p / t.sum() - target) ** 2) / share).sum()
    got = np.array([x.rate for x in rated.orderBy("doc_id").collect()])
    assert fit.converged and got.min() >= least and squares(got) <= squares(r) + 1e-8
    assert np.allclose(t * got @ p / t.sum(), t * r @ p / t.sum(), atol=1e-4)  # the totals of the optimum are unique


def test_sample_of_each_label(spark):
    df = spark.createDataFrame([(i, f"t{i}", "ab"[i % 3 == 0]) for i in range(3000)] + [(7, "t7", "c")] * 50 + [(None, "n", "d")], "doc_id long, text string, y string")
    got = common.sample_each(df, df.select("doc_id", "y"), "y", 20, 10)
    assert {k: v for k, v in Counter(y for _, y, _ in got).items() if k != "c"} == {"a": 20, "b": 20}
    luck = {r[0]: r[1] for r in df.where("doc_id is not null").select("doc_id", common._luck()).collect()}
    for y, ids in (("a", [i for i in range(3000) if i % 3]), ("b", range(0, 3000, 3))):
        assert {i for i, z, _ in got if z == y} == {*sorted(ids, key=lambda i: luck[i])[:20]}


def test_license_scan_of_a_text_full_of_licences(spark):
    n = 4000
    text = " ".join(f"this text {i} is under the mit license and gnu general public license version 3 or later" for i in range(n))
    r = licenses.scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert r.n_base == n and r.labels == "gpl-3.0,mit"
    places = [(d.start, d.end) for d in r.detections]
    assert places == [x for i in range(n) for x in ((17 * i + 4, 17 * i + 8), (17 * i + 9, 17 * i + 17))]
