"""Periodic runs, the audit of filters and sentence pieces against plain versions."""

import hashlib
import random
import zlib
from fractions import Fraction
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import filter_audit as fa
from quern.llm import periodic_runs as pr
from quern.llm import sentence_pieces as pc
from quern.llm.queries import ORACLES, QUERIES, vocabulary

ODD = [None, "", " \t\n", "a", "a " * 30, "x y " * 9 + "x", " ".join("abcdefgh"), "a b c " * 7 + "d " * 8 + "b c " * 5, "ü\x0bü\x0cü ü ü ü ü ü", "w" * 300_000, "p q r s " * 12_000, "É﻿ É﻿ " * 6]


def texts(seed: int, n: int, alphabet: str = "abc") -> list[str]:
    r, out = random.Random(seed), []
    for _ in range(n):
        words = []
        while r.random() < 0.8:
            unit = [r.choice(alphabet) for _ in range(r.randint(1, 5))]
            words += (unit * r.randint(1, 7))[: r.randint(1, 30)]
        out.append(" ".join(words))
    return out


def plain_runs(w, min_length=6, e=4):
    """Each stretch by its definition."""
    found, n = [], len(w)
    for p in range(1, n // e + 1):
        at = 0
        while at < n - p:
            if w[at] != w[at + p]:
                at += 1
                continue
            end = at
            while end < n - p and w[end] == w[end + p]:
                end += 1
            s, length = at, end + p - at
            if length >= max(min_length, e * p) and not any(all(w[i] == w[i + q] for i in range(s, s + length - q)) for q in range(1, p)):
                found.append((s, length, p))
            at = end
    return sorted(found, key=lambda x: (x[0], x[2]))


def plain_digest(doc_id, text):
    w = (text or "").encode().split()
    n = len(w)
    if doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    runs = plain_runs(w)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {i for s, length, p in runs for i in range(s + p, s + length)}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return doc_id, len(runs), *top, sha("".join(f"{s},{m},{p}\n" for s, m, p in runs).encode()), sha(b" ".join(x for i, x in enumerate(w) if i not in gone))


@pytest.mark.parametrize("alphabet", ["a", "ab", "abcd"])
@pytest.mark.parametrize("e", [2, 3, 4])
def test_runs_by_their_definition(alphabet, e):
    some = [t.split() for t in texts(e, 60, alphabet)] + [[]]
    for least in (1, 6):
        got = pr.runs([np.array([ord(c) for c in w], dtype=np.int64) for w in some], least, e)
        assert [[tuple(map(int, r)) for r in x] for x in got] == [plain_runs(w, least, e) for w in some]


def test_extensions_are_common_prefixes():
    r = random.Random(5)
    s = np.array([r.randint(0, 1) for _ in range(200)] + [9])
    x, y = (a.ravel() for a in np.meshgrid(np.arange(201), np.arange(201)))
    x, y = x[x != y], y[x != y]
    plain = [next(k for k in range(300) if max(a, b) + k >= 201 or s[a + k] != s[b + k]) for a, b in zip(x, y, strict=True)]
    assert pr.Extensions(s)(x, y).tolist() == plain


def test_run_digests_of_odd_texts_and_of_a_table(spark, data):
    # of the longest odd texts the plain version takes too long: their runs are known
    rows = list(enumerate(ODD + texts(1, 300))) + [(None, "a a a a a a a"), (3, "a"), (7, None)]
    rows = [(i, t) for i, t in rows if not t or len(t) < 50_000]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("runs", F.lit(1)).withColumn("n_words", F.lit("x"))
    key = lambda x: tuple(map(str, x))
    assert sorted(map(tuple, pr.run_digest(df).collect()), key=key) == sorted((plain_digest(*r) for r in rows), key=key)
    long = spark.createDataFrame([(1, ODD[10]), (2, ODD[9])], "id int, text string")
    assert [(r.id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in pr.periodic_runs(long).orderBy("id").collect()] == [(1, 48_000, [(0, 48_000, 4)], "p q r s"), (2, 1, [], "w" * 300_000)]
    assert pr.run_digest(df.limit(0)).count() == 0
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r) for r in QUERIES["op11_periodic_runs"](spark, data).collect()}
    short = [r for r in docs if len(r.text or "") < 12_000]
    assert len(got) == len(docs) and len(short) > 100
    for r in short:
        assert got[r.doc_id] == plain_digest(*r)


def test_other_columns_of_runs_stay(spark):
    df = spark.createDataFrame([(1, "a a a a a a b", [1.5], {"k": 1})], "id int, body string, x array<double>, runs map<string,int>")
    row = pr.periodic_runs(df, "body", prefix="t_").first()
    assert row.asDict(True) == {"id": 1, "body": "a a a a a a b", "x": [1.5], "runs": {"k": 1}, "t_n_words": 7, "t_runs": [{"start": 0, "length": 6, "period": 1}], "t_collapsed": "a b"}
    with pytest.raises(ValueError):
        pr.periodic_runs(df, "body", min_periods=1)


def plain_audit(docs, labels):
    """Every document through every order, filter by filter."""
    good = {i for i, q, x in labels if q == 1}
    toxic = {i for i, q, x in labels if x == 1}
    told = []
    for i, lang, text in docs:
        text = text or ""
        w = text.encode().split()
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text), "D": any(c in "#$%&*|" for c in text)}
        fails["E"] = i is not None and any(j is not None and j < i and (t or "") == text for j, _, t in docs)
        told.append((lang or "", i, fails))
    out = {}
    for part in {p for p, _, _ in told}:
        mine = [(i, f) for p, i, f in told if p == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = list(mine)
            for step, name in enumerate(order, 1):
                lost, left = [x for x in left if x[1][name]], [x for x in left if not x[1][name]]
                fails = sum(f[name] for _, f in mine)
                only = sum(f[name] and sum(f.values()) == 1 for _, f in mine)
                shapley[name] += len(lost)
                out[part, "".join(order), step] = [len(left), len(lost), fails - len(lost), only, sum(i in good for i, _ in lost), sum(i in toxic for i, _ in lost)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def test_audit_by_going_through_every_order(spark):
    r = random.Random(3)
    base = ["", " ".join(f"w{k}" for k in range(250)), "one two " * 150, "ONE two", " ".join(f"v{k}" for k in range(220)) + " #", "a|b", "É" * 40 + "A"]
    docs = [(r.randint(0, 60), r.choice(["en", "de", None, ""]), r.choice(base)) for _ in range(150)] + [(None, "en", base[1]), (None, "en", base[1]), (5, "en", None), (61, "fr", None)]
    docs += [docs[0]] * 3
    labels = [(r.randint(0, 70), r.choice([0, 1, None]), r.choice([0, 1, None])) for _ in range(60)] + [(None, 1, 1)]
    d = spark.createDataFrame(docs, "doc_id long, lang string, text string").withColumn("mask", F.lit(3)).withColumn("n", F.lit("n"))
    m = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("text", F.lit(1))
    got = {(x.part, x.filter_order, x.step): tuple(x[c] for c in fa.COUNTS) for x in fa.filter_audit(d, m).collect()}
    assert got == plain_audit(docs, labels)
    assert fa.filter_audit(d.limit(0), m).count() == 0
    assert {x.good_lost for x in fa.filter_audit(d, m.limit(0)).collect()} == {0}


def test_audit_of_a_long_text(spark):
    d = spark.createDataFrame([(1, "en", "w v " * 100_000), (2, "en", "w v " * 100_000)], "doc_id long, lang string, text string")
    m = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {(x.filter_order, x.step): tuple(x[c] for c in fa.COUNTS) for x in fa.filter_audit(d, m).collect()}
    assert got["BEACD", 1] == (0, 2, 0, 1, 0, 0, 60 * 2 + 60) and got["EBACD", 1][:2] == (1, 1)


@pytest.mark.parametrize("name", ["op12_filter_audit"])
def test_same_as_sql(name, spark, data, same_rows):
    same_rows(QUERIES[name](spark, data), ORACLES[name])


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))


TOUGH = ["", " ", "  a", "a  ", "a   b\n\nc\td", "▁", "▁▁a ▁b", "Ωmega ≈ 日本語テキスト 🙂🙂", "<s></s><unk><0x41>", "\x00\x01a", "�", " x", "A" * 5000, " " * 3000 + "z", "日" * 4000, "naïve café é", "word " * 3000, "퟿\U0010ffff", "0123456789" * 30]


def test_pieces_and_spans_are_those_of_the_library(library):
    model = pc.Model(vocabulary("piece_bpe_32k.model"))
    r = random.Random(11)
    some = TOUGH + ["".join(r.choice("ab ▁éth日🙂\n the in") for _ in range(r.randint(0, 60))) for _ in range(400)]
    ends, ids, begin, end = pc.Encoder(model)(some)
    decoder = pc.Decoder(model)
    for k, text in enumerate(some):
        at = slice(int(ends[k]), int(ends[k + 1]))
        assert ids[at].tolist() == library.encode(text), text[:80]
        assert decoder(ids[at].tolist()) == library.decode(ids[at].tolist())
        if len(text) < 200:
            told = library.encode(text, return_type="proto").pieces
            assert list(zip(begin[at].tolist(), end[at].tolist(), strict=True)) == [(p.begin, p.end) for p in told]


def test_decoding_of_any_ids(library):
    decoder, r = pc.Decoder(pc.Model(vocabulary("piece_bpe_32k.model"))), random.Random(2)
    lists = [[r.randrange(32_000) if r.random() < 0.5 else r.randrange(300) for _ in range(r.randint(0, 12))] for _ in range(600)] + [[], [259], [259, 259, 1], [1, 2, 0], [35, 259], [1, 260, 260]]
    for ids in lists:
        assert decoder(ids) == library.decode(ids), ids


def test_character_map_is_that_of_the_library():
    """The rule of the library for NFKC, compiled by it: same text and same origin of each character."""
    import sentencepiece

    for trim in (False, True):
        norm = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc", add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=trim)
        rules = dict(x for k, v in pc.fields(norm.serialized_model_proto()) if k == 3 for x in pc.fields(v))
        own = pc.Model.__new__(pc.Model)
        own._rules(rules)
        r = random.Random(4)
        for text in ["", "  ", "ｆｕｌｌ　ｗｉｄｔｈ", "ﬁne ①②③ ㌔ é äb", " a  b \t c 　 ", "½ ㍿x", "가 한글"] + ["".join(r.choice("ab ﬁ①é　\t½ﾊﾞ日") for _ in range(30)) for _ in range(200)]:
            clean, origin = own.normalise(text)
            want, froms = norm.normalize(text, with_offsets=True)
            assert clean == want, text
            bytes_at = np.cumsum([0, *(len(c.encode()) for c in text)])
            assert origin.tolist() == [bytes_at[k] for k in froms], text


def test_pieces_of_a_table_and_of_odd_rows(spark, data, library):
    rows = [(k, t) for k, t in enumerate([None, *TOUGH, "a" * 300_000 + " b"])] + [(None, "x"), (3, "y"), (3, "y")]
    df = spark.createDataFrame(rows, "id int, text string").withColumn("ids", F.lit("old")).withColumn("decoded", F.lit(1.0))
    path = vocabulary("piece_bpe_32k.model")
    out = pc.sentencepiece_decode(pc.sentencepiece_encode(df, path), path)
    assert sorted(out.columns) == sorted(["id", "text", "ids", "begins", "ends", "decoded"])
    for r in out.collect():
        assert r.ids == library.encode(r.text or "") and r.decoded == library.decode(r.ids)
    assert out.count() == len(rows) and pc.sentencepiece_encode(df.limit(0), path).count() == 0
    assert [r.decoded for r in pc.sentencepiece_decode(spark.createDataFrame([(None,), ([],)], "ids array<int>"), path).collect()] == [None, ""]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    for r in QUERIES["op13_sentence_pieces"](spark, data).collect():
        ids = library.encode(want[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256, r.span_bytes) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)), len(want[r.doc_id].encode()))


def test_models_of_other_kinds_are_refused(tmp_path):
    (tmp_path / "m").write_bytes(bytes([0x12, 0x02, 0x18, 0x01]))  # a unigram model
    with pytest.raises(ValueError):
        pc.Model(str(tmp_path / "m"))
