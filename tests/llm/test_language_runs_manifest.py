"""Language ID, periodic runs and the Merkle manifest against brute force, with nulls, repeats, ties, long and empty texts."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import pytest

from canopy.llm import language, merkle, oracle, periodic
from canopy.llm.words import Rolling

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def crc(doc_id):
    return zlib.crc32(str(doc_id).encode())


# ---------------------------------------------------------------- periodic runs


def brute_runs(w, least=24, times=3):
    out, n = [], len(w)
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if (length := j - i + q) >= max(least, times * q):
                run = w[i : i + length]
                if not any(run[d:] == run[:-d] for d in range(1, q)):
                    out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out)


def run_text(rng, size):
    w = []
    while len(w) < size:
        if rng.random() < 0.5 or not w:
            w += [f"w{rng.randrange(rng.choice([2, 3, 60]))}" for _ in range(rng.randint(1, 30))]
        else:
            p = rng.randint(1, min(len(w), 20))
            w += (w[-p:] * 12)[: rng.randint(1, 60)]
    return w


def test_runs_equal_brute_force():
    rng, rolling = random.Random(3), Rolling()
    for _ in range(300):
        texts = [[x.encode() for x in run_text(rng, rng.randint(0, 160))] for _ in range(4)]
        assert periodic.runs_of_texts(texts, rolling) == [brute_runs(w) for w in texts]
        assert periodic.runs_of_texts(texts, rolling, 9, 4) == [brute_runs(w, 9, 4) for w in texts]
        assert [periodic.find_runs([*map(hash, w)]) for w in texts] == [brute_runs(w) for w in texts]


def test_z_function():
    assert periodic.z_function([1, 1, 2, 1, 1, 2, 1]) == [0, 1, 0, 4, 1, 0, 1]
    assert periodic.z_function([]) == []


def test_document_runs(spark):
    rng = random.Random(5)
    texts = {i: " ".join(run_text(rng, rng.randint(1, 120))) for i in range(200)}
    texts |= {200: None, 201: "", 202: " \n\t ", 203: "same " * 50_000, 204: "é x " * 30, 205: "a b " * 12, 206: " ".join(f"u{i}" for i in range(400_000))}
    rows = [(i, t, None, "s", 0, "clash") for i, t in texts.items()] + [(None, "p q r " * 9, "de", None, None, "x"), (7, texts[7], "en", "s", 0, "x")]
    docs = spark.createDataFrame(rows, SCHEMA + ", runs string").repartition(3)
    got = periodic.document_runs(docs).collect()
    assert len(got) == len(rows)
    assert len({r["collapsed_sha256"] for r in got if r["doc_id"] == 7}) == 1
    planted = 0
    for r in got:
        words = ("p q r " * 9 if r["doc_id"] is None else texts[r["doc_id"]] or "").encode().split()
        n = len(words)
        if r["doc_id"] is not None and crc(r["doc_id"]) % 10 == 0 and n:
            g = crc(r["doc_id"]) // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            planted += 1
        runs = [(0, 50_000, 1)] if n == 50_000 else [] if n == 400_000 and r["doc_id"] == 206 and crc(206) % 10 else brute_runs(words)
        assert r["n_runs"] == len(runs)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        gone = {i for s, m, q in runs for i in range(s + q, s + m)}
        assert r["collapsed_sha256"] == hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest()
        if runs:
            s, m, q = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]))
            assert (r["start"], r["length"], r["period"], r["exponent_milli"]) == (s, m, q, 1000 * m // q)
        else:
            assert r["start"] is None and r["length"] is None and r["period"] is None and r["exponent_milli"] is None
    assert planted > 5
    assert periodic.document_runs(spark.createDataFrame([], SCHEMA)).count() == 0


def test_runs_interface(spark):
    docs = spark.createDataFrame([(1, "x " * 10 + "y", "k")], "collapsed long, body string, __text string")
    (row,) = periodic.periodic_runs(docs, "body", ["__text"], least=9, times=3).collect()
    assert row["__text"] == "k" and row["collapsed"] == "x y" and [tuple(x) for x in row["runs"]] == [(0, 10, 1)]
    with pytest.raises(ValueError):
        periodic.periodic_runs(docs, "body", times=2)


# ---------------------------------------------------------------- Merkle manifest


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row["doc_id"], row["source"], row["lang"], row["n_chars"], row["text"])))


def tree_of(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def siblings(levels, i):
    for level in levels[:-1]:
        run = i // 3 * 3
        yield i - run, [x for k, x in enumerate(level[run : run + 3]) if k != i - run]
        i //= 3


def brute_manifest(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r["source"]].append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        groups[s].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r)))
        trees[s] = tree_of([leaf_of(r) for r in groups[s]])
    top = tree_of([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, r in enumerate(groups[s]):
            path = [*siblings(trees[s], i), *siblings(top, k)]
            tampered = r["doc_id"] is not None and crc(r["doc_id"]) % 2 == 0 and r["text"] is not None
            node = leaf_of(r | {"text": r["text"].replace("\n", "")} if tampered else r)
            for place, others in path:
                node = digest(*others[:place], node, *others[place:])
            out.append((r["doc_id"], leaf_of(r), trees[s][-1][0], top[-1][0], digest(*(x for _, o in path for x in o)), node, node == top[-1][0]))
    return sorted(out, key=str)


def manifest_rows():
    rng = random.Random(8)
    texts = [None, "", "plain", "two\nlines", "\n", "é中\n x", "long\n" * 40_000]
    rows = [{"doc_id": i * 7 % 401, "text": rng.choice(texts), "lang": rng.choice([None, "de", "-"]), "source": "hot" if i % 2 else f"s{i % 14}", "n_chars": rng.choice([None, -3, 12])} for i in range(400)]
    rows += [{"doc_id": 1, "text": "alone\n", "lang": None, "source": None, "n_chars": 1}, {"doc_id": 2, "text": "x", "lang": "", "source": "", "n_chars": 1}, {"doc_id": 5, "text": "a\nb", "lang": None, "source": "￿", "n_chars": None}, {"doc_id": 6, "text": "a\nb", "lang": None, "source": "\U0001f600", "n_chars": None}]
    rows += [{"doc_id": None, "text": t, "lang": None, "source": "hot", "n_chars": None} for t in ("a\n", None)]
    return rows + [rows[3], rows[3], rows[4] | {"text": "another\n"}]


@pytest.mark.parametrize("height", [1, 2, 6])
def test_manifest(spark, height, monkeypatch):
    monkeypatch.setattr(merkle.manifest, "__defaults__", (height, True))
    rows = manifest_rows()
    docs = spark.createDataFrame([(*[r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")], "x", "y") for r in rows], SCHEMA + ", leaf string, grp string").repartition(5)
    got = merkle.document_manifest(docs)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    got = sorted((tuple(r) for r in got.collect()), key=str)
    assert got == brute_manifest(rows)
    assert {r[-1] for r in got} == {True, False}


def test_manifest_sql(spark):
    rows = manifest_rows()
    duck = duckdb.connect()
    duck.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    duck.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", [[r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")] for r in rows])
    assert sorted(duck.execute(oracle.MERKLE).fetchall(), key=str) == brute_manifest(rows)


def test_manifest_of_few(spark):
    assert merkle.document_manifest(spark.createDataFrame([], SCHEMA)).count() == 0
    (row,) = merkle.document_manifest(spark.createDataFrame([(3, "a\nb", None, None, None)], SCHEMA)).collect()
    assert row["leaf"] == row["subroot"] == row["root"] and row["proof_sha256"] == digest() and row["verified"] == (crc(3) % 2 == 1)


def test_stored_proofs_fold(spark):
    rows = spark.range(50).selectExpr("id", "sha2(string(id), 256) AS leaf", "string(id % 2) AS part")
    from pyspark.sql import functions as F

    got = merkle.manifest(rows, F.col("part"), F.col("id"), F.col("leaf"), F.lit(None).cast("string"), height=2).collect()
    assert len(got) == 50 and all(r["verified"] for r in got)
    for r in got:
        assert merkle.folded(bytes.fromhex(r["leaf"]), bytes(r["proof"])).hex() == r["root"]
        assert merkle.siblings_digest(bytes(r["proof"])) == r["proof_sha256"]


def test_walk_holds_few_digests_and_is_never_late():
    for height, n in ((3, 27), (5, 243), (6, 729), (6, 500), (6, 1), (5, 82)):
        leaves = [hashlib.sha256(bytes([i % 256, i // 256])).digest() for i in range(n)]
        walk = merkle.Traversal(leaves, height)
        root = merkle.block_root(leaves, height)
        assert all(merkle.folded(leaves[i], merkle.packed_path(p)) == root for i, p in enumerate(walk))
        assert not walk.late and walk.held <= 7 * height


# ---------------------------------------------------------------- language


def brute_letters(text):
    return re.findall(r"\S+", "".join(c if c.isalpha() else " " for c in text.lower()))


def brute_model(rows, longest=4):
    words, grams = defaultdict(Counter), [defaultdict(Counter) for _ in range(longest + 1)]
    for text, lang in rows:
        for w in brute_letters(text):
            words[lang][w] += 1
            for n in range(1, longest + 1):
                for i in range(len(w) + 3 - n):
                    grams[n][lang][f" {w} "[i : i + n]] += 1
    return words, grams


def brute_scores(model, text, langs, longest=4):
    words, grams = model

    def log(counts, key, lang):
        known = set().union(*counts.values())
        return math.log((counts[lang][key] + 0.5) / (sum(counts[lang].values()) + 0.5 * (len(known) + 1)))

    out = dict.fromkeys(langs, 0.0)
    for w in brute_letters(text):
        if any(words[x][w] for x in langs):
            for x in langs:
                out[x] += log(words, w, x)
            continue
        marked, places, own = f" {w} ", 0, Counter()
        for i in range(len(marked)):
            for n in range(longest, 0, -1):
                gram = marked[i : i + n]
                if len(gram) == n and any(grams[n][x][gram] for x in langs):
                    places += 1
                    for x in langs:
                        own[x] += log(grams[n], gram, x)
                    break
        for x in langs:
            out[x] += own[x] / max(1, places)
    return out


LANG_TEXTS = {"aa": "kana tiru molo pe sado kana kana", "bb": "stren gropf schlut und krach stren", "c c": "oui eaux été eaux l'eau"}


def test_languages_equal_brute_force(spark):
    rng = random.Random(2)
    rows = []
    for i in range(60):
        lang = rng.choice(list(LANG_TEXTS))
        own = LANG_TEXTS[lang].split()
        rows.append((i, " ".join(rng.choice(own) + rng.choice(["", "", "ka", "pf"]) for _ in range(rng.randint(1, 12))), lang, "s", 0, "x"))
    rows += [(100, None, "aa", "s", 0, "x"), (101, "", "aa", "s", 0, "x"), (102, "12 ½ ² --", "bb", None, 0, "x"), (103, "zzz qqq", None, None, None, "x"), (104, "中文 1", "bb", None, 0, "x"), (105, "KANA ½kana 7", None, None, 0, "x"), (None, "krach", "bb", None, None, "x"), (5, rows[5][1], rows[5][2], None, None, "x")]
    docs = spark.createDataFrame(rows, SCHEMA + ", lang_pred string").repartition(3)
    got = language.document_languages(docs).collect()
    assert len(got) == len(rows)
    checksum = lambda i: zlib.crc32(b"" if i is None else str(i).encode())
    model = brute_model([(r[1], r[2]) for r in rows if checksum(r[0]) % 4 != 2 and r[1] and r[2]])
    by_id = {r[0]: r[1] for r in rows}
    for r in got:
        text = by_id[r["doc_id"]]
        assert r["held_out"] == (checksum(r["doc_id"]) % 4 == 2)
        if not brute_letters(text or ""):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        scores = brute_scores(model, text, sorted(LANG_TEXTS))
        top = max(scores.values())
        assert r["lang_pred"] == min(x for x in scores if scores[x] > top - 1e-9)
        assert r["score"] == pytest.approx(1 / sum(math.exp(x - top) for x in scores.values()))


def test_bounded_model(spark):
    docs = spark.createDataFrame([(i, f"often seldom{i} w{chr(97 + i % 26)} often", "en" if i % 2 else "xx", None, 0) for i in range(300)], SCHEMA)
    from pyspark.sql import functions as F

    model = language.train(docs, F.lit(True), most_words=10, most_grams=20, longest=3)
    assert 0 < len(model.words) <= 10 and "often" in model.words
    assert all(sum(len(g) == n for g in model.grams) <= 20 for n in (1, 2, 3)) and model.longest == 3
    assert language.identify(docs, model).count() == 300


def test_nothing_learnt(spark):
    docs = spark.createDataFrame([(1, "some words", None, None, 0), (2, None, None, None, 0)], SCHEMA)
    assert [tuple(r) for r in language.document_languages(docs).select("lang_pred", "score").collect()] == [("und", 0.0)] * 2
    assert language.document_languages(spark.createDataFrame([], SCHEMA)).count() == 0


def test_long_and_many_unseen_words(monkeypatch):
    monkeypatch.setattr(language, "_MEMO", 8)
    model = language.LanguageModel(["a", "b"], {"ka": {"a": 3}}, [{"k": {"a": 5}, "z": {"b": 2}}], {"a": 3, "b": 1}, [{"a": 9, "b": 4}])
    texts = [" ".join("k" * (1 + i % 50) for i in range(500)), "z" * 1_000_000, None, "ka"]
    sums, counts = model.scorer().sums(texts)
    assert counts.tolist() == [500, 1, 0, 1] and sums.argmax(axis=1).tolist() == [0, 1, 0, 0]
    each = model.scorer()
    assert sums.tolist() == [each.sums([t])[0][0].tolist() for t in texts]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.document_languages(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.99 * len(got) > 100
