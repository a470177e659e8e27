"""Each training-data operator against a brute-force version, on a fixture with nulls, empty and long texts, ties, repeated rows and extra columns."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from panelforge.llm import ann, chat_format, decontaminate, jaccard_join, language_id, license_scan, line_dedup, mixing, quality, suffix_dedup
from panelforge.llm._stage import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, slot int, score string"


def corpus():
    rng = np.random.default_rng(5)
    vocab = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnrst"]
    rows = []
    for i in range(120):
        words = rng.choice(vocab, rng.integers(1, 90))
        rows.append(" ".join(w + ("\n" if rng.random() < 0.08 else "") for w in words))
    rows += [rows[3], rows[3], rows[7] + " bal", rows[7], "x" + rows[9][1:], rows[11] + "\n" + rows[12], "", None, " \n\t ", "...", "one", "ONE", "two words", "é ü ñ", "bal " * 3000]
    rows += ["bil bol bal " * 5 + rows[20][:70] + f" {i}" for i in range(6)]
    out = [(i, t, None if i % 9 == 0 else "ab"[i % 2], None if i % 7 == 0 else f"s{i % 3}", None if t is None else len(t), 1, "x") for i, t in enumerate(rows)]
    out.append(out[5])  # a repeated row
    out.append((None, rows[4], "a", "s1", 3, 1, "x"))  # no id
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def union(n, links):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_components(spark):
    links = [(1, 2), (3, 2), (3, 9), (5, 6), (6, 5), (7, 7), (10, 11), (11, 12), (12, 13), (13, 14), (4, 14), (None, 3)]
    got = {r.id: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {2: 1, 3: 1, 9: 1, 6: 5, 10: 4, 11: 4, 12: 4, 13: 4, 14: 4}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_jaccard_join(spark, docs, none):
    for k, percent in ((3, 90), (5, 80)):
        rows = [r for r in corpus() if r[0] is not None]
        sets = []
        for r in rows:
            w = re.findall(r"[^\x20\x09-\x0D]+", lower(r[1]))
            sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
        links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
        root = union(len(rows), links)
        ids = [min(rows[j][0] for j in range(len(rows)) if root[j] == root[i]) for i in range(len(rows))]
        want = sorted((r[0], len(s), c) for r, s, c in zip(rows, sets, ids, strict=True))
        got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.join(docs, k, percent).collect() if r.doc_id is not None)
        assert got == want
    assert jaccard_join.join(none).count() == 0


def test_suffix_dedup(docs, none):
    rows = corpus()
    first = {}
    for r in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        b = (r[1] or "").encode()
        for i in range(len(b) - 49):
            first.setdefault(b[i : i + 50], r[0])
    want = []
    for r in rows:
        b = (r[1] or "").encode()
        m = np.zeros(len(b), bool)
        for i in range(len(b) - 49):
            if r[0] is not None and first[b[i : i + 50]] < r[0]:
                m[i : i + 50] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~m])
        want.append((-1 if r[0] is None else r[0], len(b), int(m.sum()), int((np.diff(np.concatenate(([0], m.astype(int)))) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    got = [(-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in suffix_dedup.dedup(docs).collect()]
    assert sorted(got) == sorted(want)
    assert suffix_dedup.dedup(none).count() == 0


def test_merge_never_goes_wrong():
    rng = np.random.default_rng(1)
    runs = []
    for _ in range(5):
        s = sorted(bytes(rng.integers(97, 99, rng.integers(1, 9)).tolist()) for _ in range(rng.integers(0, 30)))
        runs.append((s, [suffix_dedup._lcp(a, b) for a, b in zip([b"", *s[:-1]], s, strict=True)] if s else []))
    got, last = [], b""
    for r, i, common in suffix_dedup.merge(runs):
        assert common == suffix_dedup._lcp(last, runs[r][0][i])
        last = runs[r][0][i]
        got.append(last)
    assert got == sorted(x for r in runs for x in r[0])


def test_runs_and_ranges_against_windows(monkeypatch):
    """Removed windows by runs and ranges equal a dictionary of windows; the tree sees only blocks of several documents and strings."""
    rng = np.random.default_rng(3)
    letters = np.frombuffer(b"ab\0c", np.uint8)
    pool = [bytes(rng.choice(letters, 90)) for _ in range(6)]
    docs = []
    for i in range(60):
        t = bytearray(bytes(rng.choice(letters, rng.integers(0, 40))) + pool[rng.integers(6)] + bytes(rng.choice(letters, 30)) + pool[rng.integers(6)][: rng.integers(30, 90)])
        t[rng.integers(len(t))] = 120
        docs.append((i // 2 * 3 - 20, i, bytes(t)))  # two texts to an id, negative ids too
    first = {}
    for d, _, t in docs:
        for i in range(len(t) - 49):
            first[t[i : i + 50]] = min(d, first.get(t[i : i + 50], d))
    want = {(tie, i) for d, tie, t in docs for i in range(len(t) - 49) if first[t[i : i + 50]] < d}
    cuts = suffix_dedup.bounds(4, 50)
    batches = []
    for part in (docs[::3], docs[1::3], docs[2::3]):
        held = []
        for d, tie, t in part:
            data = np.frombuffer(t, np.uint8)
            h, place, lo, hi, own = suffix_dedup.anchors(data, np.array([0, len(t)]), 50)
            held.append(suffix_dedup.entries(data, h[place] >> np.uint64(16), place, lo, hi, np.full(len(own), d), np.full(len(own), tie), np.zeros(len(own), np.int64), 50))
        batches.append(suffix_dedup.front_coded(held, cuts, 50))
    rows = [r for b in batches for r in b.to_pylist()]
    merged = []
    tree = suffix_dedup.merge
    monkeypatch.setattr(suffix_dedup, "merge", lambda runs: merged.extend(x for r in runs for x in r[0]) or tree(runs))
    spans = []
    for k in {r["r"] for r in rows}:
        spans += suffix_dedup.merged_spans(pa.Table.from_pylist([r for r in rows if r["r"] == k], batches[0].schema), 50).to_pylist()
    assert {(s["tie"], i) for s in spans for i in range(s["lo"], s["hi"] - 49)} == want and want
    entries = sum(len(r["meta"]) // suffix_dedup._META.itemsize for r in rows if r["meta"] is not None)
    assert 0 < len(merged) < entries / 2, (len(merged), entries)


def test_ranges_get_about_as_many_anchors():
    data = np.random.default_rng(4).integers(97, 123, 400_000).astype(np.uint8)
    h, place, *_ = suffix_dedup.anchors(data, np.array([0, len(data)]), 50)
    held = np.bincount(np.searchsorted(suffix_dedup.bounds(64, 50), (h[place] >> np.uint64(16)).astype(np.int64), "right"), minlength=64)
    assert held.max() < 1.3 * held.mean(), held  # the first 64th of the fingerprints has 16 times the mean


def test_long_texts_in_segments(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 100)
    rng = np.random.default_rng(2)
    a = "".join(rng.choice(list("abcdefgh"), 900))
    b = "z" * 70 + a[130:640] + "y" * 90
    data = np.frombuffer(b.encode(), np.uint8)
    whole = suffix_dedup.anchors(data, np.array([0, len(data)]), 50)
    seen = set()
    for s, part, o in suffix_dedup.segments(data, np.array([0, len(data)]), 50):
        _, place, lo, hi, _ = suffix_dedup.anchors(part, o, 50)
        for p, x, y in zip(place, lo, hi, strict=True):
            seen |= {(p + s, w + s) for w in range(x, y + 1)}
    assert seen == {(p, w) for p, x, y in zip(*whole[1:4], strict=True) for w in range(x, y + 1)}


def test_line_dedup(docs, none):
    rows = corpus()
    last = 1 << 62  # a row without id comes after all others
    lines, places = {}, []
    for r in rows:
        for i, t in enumerate((r[1] or "").split("\n")):
            if t.strip(" "):
                places.append((last if r[0] is None else r[0], i, lines.setdefault(t, len(lines))))
    names = list(lines)
    sets = [{t[i : i + 8] for i in range(max(1, len(t) - 7))} for t in names]
    root = union(len(names), [(i, j) for i in range(len(names)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9])
    best = {}
    for d, i, n in places:
        best[root[n]] = min(best.get(root[n], (d, i)), (d, i))
    keep = {(d, i) for d, i, n in places if best[root[n]] == (d, i)}
    want = {r[0]: "\n".join(t for i, t in enumerate((r[1] or "").split("\n")) if not t.strip(" ") or (last if r[0] is None else r[0], i) in keep) for r in rows}
    got = line_dedup.dedup(docs).collect()
    assert len(got) == len(rows) and "lang" in got[0].asDict()
    assert [r.doc_id for r in got if (r.text or "") != want[r.doc_id]] == []
    assert line_dedup.dedup(none).count() == 0


def test_line_bands_meet_short_lines(spark):
    rng = np.random.default_rng(6)
    for shared in (8, 16, 32, 96):
        pairs = []
        for i in range(4000):
            t = "".join(rng.choice(list("abcdefghijklmnop"), shared + 7))
            tail = shared // 8  # shingles of each line alone: similarity 0.8
            # random tails of different letters, so that their shingles differ too
            pairs += [(2 * i + side, t + "".join(rng.choice(list(letters), tail))) for side, letters in enumerate(("qrstuvwxyz", "QRSTUVWXYZ"))]
        keys = line_dedup.bands(spark.createDataFrame(pairs, "id long, line string"))
        met = keys.groupBy(F.expr("id div 2").alias("pair"), "key").count().where("count = 2").select("pair").distinct().count()
        assert met / 4000 >= 0.99, (shared, met)


def test_chat_format(spark):
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", "a\\b### c</turn>\n### user: x"), (1, 2, "user", None), (2, 0, "assistant", ""), (2, 0, "assistant", "same"), (3, 5, None, "only"), (4, 0, "ro:le: x", "t\\"), (4, None, "assistant", "null turn first"), (None, 0, "assistant", "z"), (5, 0, "assistant", "ok" * 40000)]
    df = spark.createDataFrame([(*t, "x") for t in turns], "conv_id long, turn long, role string, text string, formatted string")
    ex = chat_format.examples(df)
    got = {r.conv_id: r for r in chat_format.read_back(ex).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [("user", "hi"), ("assistant", "a\\b### c</turn>\n### user: x"), ("user", "")]
    assert got[1].loss == "a\\b### c</turn>\n### user: x" and got[2].loss == "same" and got[4].loss == "null turn first"
    assert [(t.role, t.text) for t in got[4].turns] == [("assistant", "null turn first"), ("ro:le: x", "t\\")]
    assert [(t.role, t.text) for t in got[3].turns] == [("", "only")] and got[3].loss == "" and got[5].loss == "ok" * 40000 and got[None].loss == "z"
    one = ex.where("conv_id = 1 and trainable").collect()
    assert len(one) == 1 and one[0].formatted[one[0].loss_start : one[0].loss_end] == "a\\\\b\\### c\\</turn>\n\\### user: x"
    assert chat_format.read_back(chat_format.examples(df.limit(0))).count() == 0


def test_license_scan(spark, docs, none):
    texts = ["Under the MIT\nlicense here, under the mit license", "CC-BY-NC 4.0", "apache license, version 2.0 apache license version 2", license_scan.TEMPLATES["bsd"].replace("source", "src"), "no", None, "All rights reserved."]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, labels int")
    got = {r.doc_id: r for r in license_scan.scan(df).collect()}
    assert (got[0].n_base, got[0].first_word, got[0].last_word, got[0].base_labels) == (2, 0, 5, "mit")
    assert got[1].base_labels == "cc-by-nc" and got[2].n_base == 2 and got[3].labels == "bsd" and got[3].base_labels == "" and 0.8 <= got[3].score < 1
    assert got[4].n_words == 1 and got[5].n_words == 0 and got[5].first_word is None and got[6].labels == "all-rights-reserved"
    rows = {r.doc_id: r.n_words for r in license_scan.scan(docs).collect()}
    assert all(rows[r[0]] == len(license_scan.words_of(r[1] or "")) for r in corpus())
    assert license_scan.scan(none).count() == 0


def test_license_scan_of_wrapped_notices(spark):
    rows, want = [], {}
    for width in (3, 5, 8):
        for name, text in license_scan.TEMPLATES.items():
            w = text.split()
            want[len(rows)] = name
            rows.append((len(rows), "some code\n" + "\n".join(" * " + " ".join(w[i : i + width]) for i in range(0, len(w), width)) + "\nmore code"))
    w = license_scan.TEMPLATES["bsd"].split()
    rows.append((len(rows), "\n".join(x + " filler" * 6 for x in w)))  # too far apart
    rows += [(len(rows), "\n".join(w[:11])), (len(rows) + 1, "\n".join(w[11:]))]  # two documents
    got = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), phrases={}).collect()}
    assert all(k in got[d].labels.split(",") and got[d].score == 1 for d, k in want.items())
    assert all(got[d].labels == "" for d in range(len(want), len(rows)))
    rng = np.random.default_rng(8)
    t = {"a": "p q r s t p", "b": "q u v"}
    texts = ["".join(rng.choice(list("pqrstuvxyz")) + rng.choice([" ", "\n"]) for _ in range(n)) for n in rng.integers(1, 30, 300)]
    found = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), t, {}).collect()}
    for d, x in enumerate(texts):
        best = {}
        for k, v in t.items():
            s, n, w = set(v.split()), -(-len(v.split()) * 5 // 4), x.split()
            best[k] = max([len(set(b) & s) / len(s) for b in [line.split() for line in x.split("\n")] + [w[i : i + n] for i in range(len(w))]])
        ok = {k: c for k, c in best.items() if c >= 0.8}
        assert found[d].labels == ",".join(sorted(ok)) and abs(found[d].score - max(ok.values(), default=0)) < 1e-12


def test_language_id(spark, docs, none):
    rng = np.random.default_rng(0)
    words = {"xx": ["the", "and", "thing", "other", "with"], "yy": ["die", "und", "schön", "zwei", "nicht"]}
    rows = [(i, " ".join(rng.choice(words[k], 30)), k, 1) for i in range(80) for k in ("xx", "yy")[i % 2 : i % 2 + 1]]
    rows += [(900, None, "xx", 1), (901, "123 !!", "xx", 1), (902, "", None, 1), (903, "the thing", None, 1), (904, "Ω", None, 1)]
    got = {r.doc_id: r for r in language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")).collect()}
    assert all(got[i].lang_pred == ("xx", "yy")[i % 2] for i in range(80)) and got[903].lang_pred == "xx" and got[904].lang_pred in words
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (900, 901, 902))
    assert language_id.identify(none).count() == 0 and language_id.identify(docs).count() == len(corpus())
    assert {r.lang_pred for r in language_id.identify(docs.withColumn("lang", docs["lang"].substr(9, 9)).where("false")).collect()} == set()


def test_ppm_is_a_distribution():
    m = language_id.Model.fit({"a": ["abracadabra abba", "cab"], "b": ["zzz yzy", ""]})
    np.testing.assert_allclose(np.exp(-m.cost).sum(1), 1, atol=1e-5)
    data = np.frombuffer(b"abba zyz", np.uint8)
    two = m.lengths(data, np.array([0, 4, 4, 8]))
    np.testing.assert_allclose(two[0], m.lengths(data[:4], np.array([0, 4]))[0], rtol=1e-6)
    assert (two[1] == 0).all() and two[0].argmin() == 0 and two[2].argmin() == 1


def test_quality(spark, docs, none):
    rng = np.random.default_rng(0)
    good = [(i, " ".join(rng.choice(["one", "two", "three", "four", "seven"], 40)) + ".", 1) for i in range(60)]
    bad = [(100 + i, " ".join(rng.choice(["ONE!!", "TWO!!", "SIX!!"], 40)), 0) for i in range(60)]
    rows = good + bad
    df = spark.createDataFrame([(a, b, 7) for a, b, _ in rows] + [(300, None, 7), (301, "", 7)], "doc_id long, text string, score int")
    lab = spark.createDataFrame([(a, q, 0) for a, _, q in rows if a % 3] + [(0, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.rank(df, lab).collect()}
    assert all(got[a].predicted == q for a, _, q in rows) and 0 <= got[300].score <= 1 and got[300].score == got[301].score
    assert {r.score for r in quality.rank(df, lab.where("quality = 1")).collect()} == {0.5}
    assert quality.rank(none, lab).count() == 0


def test_quality_learns_from_every_row(spark, monkeypatch):
    """4,200 rows a label: all of them move the means and the quantile, which equal NumPy's over the whole table."""
    rng = np.random.default_rng(5)
    n = 4200
    df = spark.createDataFrame([(i, " ".join(rng.choice(["one", "Two", "three!", "4"], rng.integers(3, 9)))) for i in range(2 * n)], "doc_id long, text string")
    lab = spark.createDataFrame([(i, i % 2) for i in range(2 * n)], "doc_id long, quality int")
    monkeypatch.setattr(quality, "BUCKET", 1000)
    monkeypatch.setattr(quality, "NEAR", 100)
    model = quality.fit(df, lab, F.lit(True))
    texts = [r.text.encode() for r in df.orderBy("doc_id").collect()]
    x = quality.features(np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(v) for v in texts]))))
    np.testing.assert_allclose(model.mean, x.mean(0), rtol=1e-9, atol=1e-12)
    s = np.sort(model.strength(x))
    assert abs(model.cut - (s[n - 1] + s[n]) / 2) < 1e-9


def test_decontaminate(spark, docs, none):
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(300)]
    items = [list(rng.choice(words, 30)) for _ in range(5)] + [["tiny", "item"]]
    bench = spark.createDataFrame([(i, " ".join(w), 1) for i, w in enumerate(items)] + [(50, None, 1), (51, "...", 1), (0, " ".join(items[0]), 1)], "item_id long, text string, score int")
    edited = items[1].copy()
    edited[4], edited[17] = "zz", "yy"
    texts = [" ".join([*rng.choice(words, 50), *items[0], *rng.choice(words, 50)]), " ".join(edited).upper(), " ".join([*items[2][:15], "ins", *items[2][15:]]), " ".join(rng.choice(words, 400)), None, "", "a Tiny, item!", " ".join(items[3][:15]), " ".join(items[4] * 40)]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(0, texts[0], "x")], "doc_id long, text string, pairs string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.leaks(df, bench, 0.8).collect()}
    assert set(got) == {(0, 0), (1, 1), (2, 2), (6, 5), (8, 4)} and got[1, 1].pairs == 28 and got[0, 0].similarity == 1
    assert decontaminate.leaks(none, bench).count() == 0 and decontaminate.leaks(df, bench.limit(0)).count() == 0
    assert sorted(r.doc_id for r in decontaminate.clean(df, bench, 0.8).collect()) == [3, 4, 5, 7]


def test_decontaminate_finds_every_leak(spark):
    rng = np.random.default_rng(7)
    lengths = [50, 50, 20, 17, 20, 11, 14, 12, 40]
    items = [[f"i{k}x{j}" for j in range(n)] for k, n in enumerate(lengths)]
    other = lambda n: [f"o{x}" for x in rng.integers(0, 500, n)]
    copies = [items[0][:25] + other(32) + items[0][25:], items[1][:25] + other(49) + items[1][25:], items[2][:10] + other(17) + items[2][10:]]
    copies += [[w if j % 3 != 2 or j >= 3 * int(0.3 * len(t) + 1e-9) else "zz" for j, w in enumerate(t)] for t in items[3:7]]  # every third word changed
    copies += [[x for w in t for x in (w, "ins")] for t in items[7:]]  # a word put in after every word
    docs = [other(60) + c + other(60) for c in copies] + [items[0][:34] + other(300) + items[0][34:36]]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(docs)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.pairs for r in decontaminate.leaks(df, bench).collect()}
    assert set(got) == {(i, i) for i in range(len(items))} and got[0, 0] == got[1, 1] == 50 and got[2, 2] == 20
    words = [f"v{i}" for i in range(12)]
    items = [list(rng.choice(words, n)) for n in rng.integers(3, 12, 12)]
    docs = [list(rng.choice(words, n)) for n in rng.integers(1, 60, 60)]
    code = {w: np.uint64(j) for j, w in enumerate(words)}
    num = lambda t: np.array([code[w] for w in t], np.uint64)
    need = lambda t: int(np.ceil(0.7 * len(t) - 1e-9))
    want = {(d, i) for d, t in enumerate(docs) for i, x in enumerate(items) if decontaminate.align(num(x), num(t), need(x))[1] >= need(x)}
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(docs)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(df, bench).collect()} == want


def test_alignment_is_smith_waterman():
    rng = np.random.default_rng(2)
    for _ in range(30):
        a, b = rng.integers(0, 4, rng.integers(1, 9)), rng.integers(0, 4, rng.integers(1, 12))
        h = [[(0, 0)] * (len(b) + 1) for _ in range(len(a) + 1)]
        best = (0, 0)
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                s, m = h[i - 1][j - 1]
                x = max((s + 2, m + 1) if a[i - 1] == b[j - 1] else (s - 1, m), (h[i - 1][j][0] - 1, h[i - 1][j][1]), (h[i][j - 1][0] - 1, h[i][j - 1][1]))
                h[i][j] = x if x[0] > 0 else (0, 0)
                best = max(best, h[i][j])
        assert decontaminate.align(a.astype(np.uint64), b.astype(np.uint64))[:2] == best


def test_mixing(spark, docs, none):
    for w in ([1], [3, 1, 2, 4], [5, 5], [1, 7, 2]):
        slots, q = mixing.schedule(w), sum(w)
        order = {t: i for i, s in enumerate(slots) for t in s}
        assert sorted(order) == list(range(q))
        for t in range(q + 1):
            assert all(abs(sum(order[x] == i for x in range(t)) - w[i] * t / q) < 1 for i in range(len(w)))
    got = mixing.mix(docs, {"s0": 3, "s1": 1}, block=4).collect()
    assert len(got) == len(corpus()) and len({(r.slot, r.pos) for r in got}) == len(got)
    by = {}
    for r in got:
        by.setdefault(r.slot, set()).add(r.source)
    assert all(len(s) == 1 for s in by.values())
    assert mixing.mix(none, {}).count() == 0


def test_ann(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 16)).astype("float32")
    x[50:90] = x[7]
    rows = [(i, [float(v) for v in x[i]], 1) for i in range(400)] + [(1000, None, 1), (1020, [0.0] * 16, 1), (1040, [float("nan")] * 16, 1), (1060, [None] * 16, 1), (1080, [1.0], 1), (1100, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    got = {}
    for r in ann.nearest(df, df["vec_id"] % 20 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == set(range(0, 400, 20))
    hit = 0
    y = x.astype(float)
    for q, found in got.items():
        s = y @ y[q]
        best = [i for i in np.lexsort((np.arange(400), -s)) if i != q][:20]
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21)) and all(abs(f[2] - s[f[1]]) < 1e-12 for f in found)
        hit += len({f[1] for f in found} & set(best))
    assert hit / (20 * len(got)) >= 0.9
    assert ann.nearest(df.where("vec_id = 1000"), df["vec_id"] % 20 == 0).count() == 0
    few = ann.nearest(df.where("vec_id < 3"), df["vec_id"] % 20 == 0).collect()
    assert [r.rank for r in sorted(few, key=lambda r: r.rank)] == [1, 2]


def test_schedule_has_no_bound_on_sources():
    weights = [1 + i % 3 for i in range(50_000)]
    slots = mixing.schedule(weights)
    q = sum(weights)
    assert sorted(t for s in slots for t in s) == list(range(q))
    assert all(k * q // w <= t < -(-(k + 1) * q // w) for w, s in zip(weights, slots, strict=True) for k, t in enumerate(s))


def test_language_sample_is_bounded_by_rows(spark):
    rows = [(1, f"the same id {i} and many rows of it", "en") for i in range(900)] + [(2 + i, f"ein Satz {i} mit Wort und Zahl", "de") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(docs, F.lit(True))
    assert model.langs == ["de", "en"]
    got = {r.lang_pred for r in language_id.identify(docs.where("doc_id = 3")).collect()}
    assert got <= {"de", "en", "und"}
