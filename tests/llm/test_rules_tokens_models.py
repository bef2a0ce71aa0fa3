import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from corpus_fixture import words
from tokenizers import Tokenizer

from quillmark.functions.shared import new_path
from quillmark.llm import classifier, decontaminate, quality_rules, tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")


def counted(text):
    text = text or ""
    w, lines = words(text), [x for x in text.split("\n") if words(x)]
    times = Counter(tuple(w[j : j + 8]) for j in range(len(w) - 7))
    inside = set()
    for j in range(len(w) - 7):
        if times[tuple(w[j : j + 8])] > 1:
            inside.update(range(j, j + 8))
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside)


EXTRA = ["a b c d e f g h " * 3, "x\nx\n \n \nx y\r\nx", "#* $%&|<> é", "   a\x1cb", "one two three four five six seven eight"]


def test_rule_counts(spark, corpus):
    rows = [(r[0], r[1]) for r in corpus] + [(200 + i, t) for i, t in enumerate(EXTRA)]
    got = quality_rules.statistics(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = Counter((i, *counted(t)) for i, t in rows)
    assert Counter(tuple(r)[:6] for r in got) == want


def test_rules_and_forest_reject_odd_texts(spark, corpus):
    good = [(i, t, 1) for i, t, _ in corpus if t and len(words(t)) > 60 and i is not None]
    odd = [(300 + i, "".join(f"W{(i * 31 + j) % 977}$$$ " for j in range(80)), 0) for i in range(12)]
    copies = [(400 + i, f"again {i} " * 60, 0) for i in range(3)]
    rows = good + odd + copies + [(500, "too short", 1), (501, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept int")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality_rules.judge(docs, labels, 0.02).collect()}
    assert not any(got[i]["kept"] for i, _, _ in odd + copies)
    assert all(got[i]["base_failed"] for i in (400, 401, 402, 500, 501)) and not got[500]["kept"]
    assert sum(got[i]["kept"] for i, _, _ in good) >= 0.95 * len(good)
    bare = quality_rules.judge(docs, labels.limit(0)).collect()
    assert all(r["kept"] == (not r["base_failed"]) for r in bare)
    assert quality_rules.judge(docs.limit(0), labels).count() == 0


def test_isolation_paths_are_short_outside():
    rows = np.random.default_rng(1).normal(0, 1, (2000, 3))
    forest = quality_rules.Forest(rows)
    scores = forest.score(np.array([[0, 0, 0], [12, 0, 0], [9, -9, 9]], float))
    assert scores[0] < scores[1] and scores[0] < scores[2]


@pytest.mark.parametrize("ids", [
    [], [0], [255, 256, 65535, 65536, 4294967295, 7], list(range(0, 3000, 7)), [50256] * 1025])
def test_codes_give_any_token_back(ids):
    codes = tokens.Codes(tokens.pack(np.array(ids, np.uint32)))
    assert codes.size == len(ids) and codes.slice(0, len(ids)).tolist() == ids
    assert [codes[i] for i in range(len(ids))] == ids
    for a, b in ((0, 0), (1, 3), (511, 514), (5, 300)):
        if b <= len(ids):
            assert codes.slice(a, b).tolist() == ids[a:b]


def test_codes_reject_other_data():
    with pytest.raises(ValueError):
        tokens.Codes(b"x" * 40)


ODD = ["", " a", "a ", "a  b", "a \n b", "a\n\n b c", " x y", "don't  stop<|endoftext|> now", "é ñ　z  ", "tab\t x \ty"]


def test_encoder_equals_the_tokenizer():
    encoder, model = tokens.Encoder(PATH), Tokenizer.from_file(PATH)
    for text in ODD + [" ".join(ODD)]:
        assert np.frombuffer(encoder.ids(text), "<u4").tolist() == model.encode(text, add_special_tokens=False).ids


def test_token_files_round_trip(spark, docs, corpus, monkeypatch):
    monkeypatch.setattr(tokens, "SEGMENT_TOKENS", 500)
    path = new_path(spark, "codes")
    tokens.write(docs, path, PATH)
    model, start, want = Tokenizer.from_file(PATH), 0, {}
    got = sorted(tokens.read(spark, path).collect(), key=lambda r: r["start"])
    assert len(got) == len(corpus)
    ids = [r["doc_id"] for r in got]
    assert [i for i in ids if i is not None] == sorted(i for i in ids if i is not None) and ids[-2:] == [None, None]
    for doc_id, text, _ in corpus:
        own = np.array([*model.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want.setdefault(doc_id, set()).add((len(own), zlib.crc32(own.tobytes())))
    for r in got:
        assert r["start"] == start and (r["n_tokens"], r["ids_crc32"]) in want[r["doc_id"]]
        start += r["n_tokens"]
    empty_path = new_path(spark, "codes")
    tokens.write(docs.limit(0), empty_path, PATH)
    assert tokens.read(spark, empty_path).count() == 0


def test_classifier_learns_and_never_sees_held_out_rows(spark):
    rows = [(i, " ".join(f"{'good' if i % 2 else 'bad'}{(i * j) % 37}ly" for j in range(1, 30)), i % 2, i) for i in range(300)]
    docs = spark.createDataFrame([(r[0], r[1], 0.0) for r in rows] + [(900, None, 0.0), (901, "", 0.0), (None, "x", 0.0)],
                                 "doc_id long, text string, score double")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(901, None)], "doc_id long, quality int")
    model = classifier.fit(docs, labels)
    scored = classifier.score(docs, model).withColumn("held", classifier.held_out(docs["doc_id"])).collect()
    held = [r for r in scored if r["held"] and r["doc_id"] is not None and r["doc_id"] < 300]
    assert len(held) > 60 and all((r["score"] >= 0.5) == bool(r["doc_id"] % 2) for r in held)
    assert all(0 <= r["score"] <= 1 for r in scored) and len(scored) == 303
    assert all(r["held"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in scored if r["doc_id"] is not None)
    flipped = labels.selectExpr("doc_id", "if(pmod(crc32(cast(doc_id as string)), 3) = 1, 1 - quality, quality) as quality")
    assert np.array_equal(classifier.fit(docs, flipped).margins, model.margins)
    blank = classifier.fit(docs, labels.limit(0))
    assert {r["score"] for r in classifier.score(docs, blank).collect()} == {0.5}


def test_only_the_finished_model_comes_to_the_driver(spark, monkeypatch):
    base, got = "/root/testdata/sf0.001", []
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    collect = type(docs).collect
    monkeypatch.setattr(type(docs), "collect", lambda df: got.append(collect(df)) or got[-1])
    monkeypatch.setattr(type(docs), "toPandas", lambda df: pytest.fail("the sample came to the driver"))
    model = classifier.fit(docs, labels)
    assert [len(rows) for rows in got] == [1] and model.margins.any()


def test_held_out_accuracy_on_the_given_tables(spark):
    base = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    scored = classifier.score(docs.select("doc_id", "text"), classifier.fit(docs, labels)).join(labels, "doc_id")
    held = scored.filter(classifier.held_out(scored["doc_id"])).collect()
    right = sum((r["score"] >= 0.5) == bool(r["quality"]) for r in held)
    assert right >= 0.97 * len(held)


def best_matches(docs, items, similar=0.8):
    def grams(text):
        w = words((text or "").lower())
        return [tuple(w[j : j + 5]) for j in range(len(w) - 4)]

    out = {}
    for doc_id, text, _ in docs:
        g = grams(text)
        for item_id, item in items:
            t = grams(item)
            if not g or not t:
                continue
            size, theirs = min(len(t), len(g)), Counter(t)
            for s in range(len(g) - size + 1):
                both = sum((Counter(g[s : s + size]) & theirs).values())
                if both / (size + len(t) - both) >= similar:
                    key = (doc_id, item_id)
                    out[key] = max(out.get(key, 0), both / (size + len(t) - both))
    return out


def test_leaks_match_brute_force(spark, docs, corpus):
    source = {i: words(t) for i, t, _ in corpus if i}
    items = [(1, " ".join(source[3][5:35])), (2, " ".join(source[10][2:30]).upper()), (3, " ".join(source[20][:24] + ["new"] * 2)),
             (4, " ".join(source[30][4:20] + ["new"] + source[30][21:40])), (5, None), (6, "only four words here"),
             (7, " ".join(source[99][7000:7050])), (8, "the same the same the same the same the same"), (None, " ".join(source[12][:20]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.leaks(docs, bench).collect()}
    assert got == pytest.approx(best_matches(corpus, items))
    assert {i for _, i in got} >= {1, 2, 3, 7, None} and 4 not in {i for _, i in got}
    left = decontaminate.remove(docs, bench)
    gone = {d for d, _ in got}
    assert Counter(r["doc_id"] for r in left.collect()) == Counter(i for i, _, _ in corpus if i not in gone)
    assert left.columns == docs.columns
    assert decontaminate.leaks(docs.limit(0), bench).count() == 0 and decontaminate.leaks(docs, bench.limit(0)).count() == 0
