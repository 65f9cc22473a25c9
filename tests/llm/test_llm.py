"""The operators for training text: against plain Python on small cases, and odd input."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import chat, decontaminate, jaccard, language, licenses, packing, pii, queries, secrets, topk, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, start string, k string"


def docs(spark, texts):
    """documents with two more columns of clashing names, in four partitions."""
    return (
        spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", "y") for i, t in enumerate(texts)], DOCS)
        .repartition(4)
    )


def prose(rng, n, words=400):
    return " ".join(f"w{int(rng.paretovariate(0.6)) % words}" for _ in range(n))


ODD = [None, "", " \n\t ", "a", "a b c d", "é" * 50_000, "a b c d", "日本 語", "x " * 3000]


def test_pii_equals_plain_python(spark):
    texts = [
        *ODD,
        "mail a.b@c-d.example.com.+x@y.z, a@b",
        "ip 1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.255",
        "card 4111 1111 1111 1111 4111111111111112 4-1-1-1",
        "é+1 (555) 010-9999 +12 +1 2 +123456789012345678",
        "x" * 3000 + "@" + "a." * 500 + "com",
        "IBAN GB82 WEST 1234 5698 7654 32 and GB83 WEST 1234 5698 7654 32",
        "phone 555-010-9999 or 555-010-9998x",
        "1" * 20_000,
        " ".join(f"u{i}@h.org" for i in range(700)),
    ]
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        (
            "card",
            r"[0-9]([\x20-]?[0-9])+",
            lambda s: 14 <= len(d := re.sub("[^0-9]", "", s)) <= 19 and sum(
                sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))
            ) % 10 == 0
        ),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 10 <= len(re.sub("[^0-9]", "", s)) <= 15),
    ]
    rows = {
        r.doc_id: [(s.start, s.end, s.kind) for s in r.pii]
        for r in pii.scan(docs(spark, texts)).select("doc_id", "pii").collect()
    }
    for i, t in enumerate(texts):
        want = sorted(
            (m.start(), r, m.end(), k)
            for r, (k, p, ok) in enumerate(rules)
            for m in re.finditer(p, t or "")
            if ok(m[0])
        )
        assert [x for x in rows[i] if x[2] in pii.BASE] == [(s, e, k) for s, _, e, k in want]
    kinds = Counter(k for r in rows.values() for *_, k in r)
    assert kinds["iban"] == 1 and kinds["local_phone"] == 1
    clean = {r.doc_id: r.text for r in pii.redact(docs(spark, texts)).collect()}
    assert clean[0] is None and "[IBAN]" in clean[14] and "@" not in clean[17]


def test_iban_ends_before_upper_case_words(spark):
    de, gb, no = "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32", "NO9386011117947"
    cases = [  # a text and the account numbers in it
        (f"IBAN {de} BIC COBADEFFXXX", [de]),
        (f"IBAN {gb} EUR 500", [gb]),
        (f"{de} {gb} {no} 12 X", [de, gb, no]),
        (f"REF AB12 {de} OK", [de]),
        (f"é日 {de.replace(' ', '')} 500 EUR, {gb}", [de.replace(" ", ""), gb]),
        (f"{gb} And {no[:-1]}xA {no}", [gb, no]),
        ("DE88 3704 0044 0532 0130 00 BIC COBADEFFXXX", []),
        (f"pay {no}", [no]),
        (" ".join([de, "EUR 500", gb] * 300), [de, gb] * 300),
        ("AB12 " * 3000 + de, [de]),
        (None, []),
    ]
    rows = docs(spark, [t for t, _ in cases])
    found = {
        r.doc_id: [(s.start, s.end) for s in r.pii if s.kind == "iban"]
        for r in pii.scan(rows).select("doc_id", "pii").collect()
    }
    clean = {r.doc_id: r.text for r in pii.redact(rows).collect()}
    for i, (t, ibans) in enumerate(cases):
        want, rest, at = [], t, 0
        for x in ibans:
            at = t.index(x, at)
            want.append((at, at + len(x)))
            at += len(x)
        for s, e in reversed(want):
            rest = rest[:s] + "[IBAN]" + rest[e:]
        assert found[i] == want and clean[i] == rest, t


def sets_of(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


@pytest.mark.parametrize("hot", [32, 3])
def test_jaccard_equals_brute_force(spark, monkeypatch, hot):
    """hot=3 sends nearly all shared shingles through the rounds, stars and tiles."""
    monkeypatch.setattr(jaccard, "HOT", hot)
    monkeypatch.setattr(jaccard, "TILE", 8)
    rng = random.Random(1)
    texts = list(ODD)
    for _ in range(12):
        base = prose(rng, rng.randint(6, 120)).split()
        for _ in range(rng.randint(1, 7)):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = f"e{rng.random()}"
            texts.append(" ".join(w))
    line = "this very common line stands in many of the documents here"
    texts += [line + " " + prose(rng, 20) for _ in range(12)]
    rng.shuffle(texts)
    sets = [sets_of(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(docs(spark, texts)).collect()}
    assert got == {i: (len(s), find(i)) for i, s in enumerate(sets)}


def test_decontamination_finds_edited_copies(spark):
    rng = random.Random(2)
    items = [" ".join(f"q{rng.randint(0, 5000)}" for _ in range(40)) for _ in range(5)] + ["tiny one", None, ""]
    edited = items[1].split()
    for i in range(0, 40, 9):
        edited[i] = "changed"
    clean = [" ".join(f"q{rng.randint(0, 5000)}" for _ in range(300)) for _ in range(20)]
    texts = [
        *ODD,
        *clean,
        "pre " + items[0].upper().replace(" ", "!! ") + " post",
        "pre é " + " ".join(edited) + " post",
        "a tiny one here",
        items[2] + " x " + items[3]
    ]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {
        (r.doc_id, r.item_id): (r.score, texts[r.doc_id][r.start : r.end])
        for r in decontaminate.matches(docs(spark, texts), bench).collect()
    }
    n = len(ODD) + len(clean)
    assert set(got) == {(n, 0), (n + 1, 1), (n + 2, 5), (n + 3, 2), (n + 3, 3)}
    assert got[n, 0][0] == 1.0 and got[n + 1, 1][1].startswith("q") and got[n + 2, 5][1] == "tiny one"
    kept = decontaminate.drop_contaminated(docs(spark, texts), bench)
    assert kept.count() == n and kept.columns == docs(spark, texts).columns
    assert decontaminate.matches(docs(spark, texts).limit(0), bench.limit(0)).count() == 0


def test_decontamination_finds_copies_with_short_runs(spark):
    rng = random.Random(12)
    words = [f"q{rng.randint(0, 5000)}" for _ in range(40)]
    noise = [" ".join(f"n{rng.randint(0, 5000)}" for _ in range(200)) for _ in range(20)]
    copy = " ".join(w + (" extra" if i % 2 else "") for i, w in enumerate(words))
    bench = spark.createDataFrame([(0, " ".join(words))], "item_id long, text string")
    got = decontaminate.matches(docs(spark, [*noise, f"{noise[0]} {copy} {noise[1]}"]), bench).collect()
    assert [(r.doc_id, r.item_id) for r in got] == [(20, 0)]
    # Words of a corpus of 5e9, each one of 200: runs of three are not rare in it, two of them near each other are.
    item = np.array(rng.sample(range(200), 40), np.uint64)
    seeds = decontaminate.Seeds([0], [item], np.arange(200, dtype=np.uint64), np.full(200, 25_000_000), 5_000_000_000)
    text = np.array([rng.randint(300, 900) if i % 4 == 3 else int(w) for i, w in enumerate(item)], np.uint64)
    assert [x[:2] for x in seeds.search(text, np.array([0, 40]))] == [(0, 0)]
    assert not list(seeds.search(text[:3], np.array([0, 3])))


def test_smith_waterman():
    a = np.array([1, 2, 3, 4, 5], np.uint64)
    assert decontaminate.align(a, np.array([9, 1, 2, 3, 4, 5, 9], np.uint64)) == (10, 5, 1, 6)
    assert decontaminate.align(a, np.array([1, 2, 7, 4, 5], np.uint64))[:2] == (7, 4)
    assert decontaminate.align(a, np.array([7, 8], np.uint64))[:2] == (0, 0)


def test_toxicity_held_out(spark):
    rng = random.Random(3)
    texts = (
        [
            prose(rng, 60)
            + (f" {rng.choice(['horrid', 'nasty', 'vilest'])}{rng.choice(['', '!', 'ly'])}" if i % 6 == 0 else "")
            for i in range(900)
        ]
        + ODD
    )
    rows = docs(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 6 == 0)) for i in range(900)] + [(0, None)], "doc_id long, toxic int")
    model = toxicity.fit(rows, labels)
    got = {r.doc_id: r.score for r in toxicity.score(rows, model).collect()}
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum((got[i] >= toxicity.THRESHOLD) == (i % 6 == 0) for i in held) >= 0.98 * len(held)
    assert all(0 <= s <= 1 for s in got.values()) and got[900] == got[901]
    assert toxicity.score(rows, toxicity.fit(rows.limit(0), labels.limit(0))).count() == len(texts)
    assert toxicity.reject(rows, labels).columns == rows.columns


def test_language_mixture(spark):
    rng = random.Random(4)
    sounds = {"aa": "bdg", "bb": "lmn", "cc": "prs"}
    word = lambda l: "".join(rng.choice(sounds[l]) + rng.choice("aeiou") for _ in range(3))
    rows = [(i, " ".join(word(l) for _ in range(40)), l) for i, l in ((i, ("aa", "bb", "cc")[i % 3]) for i in range(300))]
    rows += [
        (300, " ".join([word("aa") for _ in range(60)] + [word("bb") for _ in range(30)]), None),
        (301, None, "aa"),
        (302, "12 !", "bb"),
        (303, "é" * 9000, None)
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_mix.lang_pred, r.lang_mix.score) for r in language.identify(df, language.fit(df)).collect()}
    assert all(got[i][0] == rows[i][2] for i in range(300))
    assert got[300][0] == "aa" and abs(got[300][1] - 2 / 3) < 0.03
    assert got[301] == ("und", 0.0) == got[302]
    assert language.identify(df, language.fit(df.limit(0))).where("lang_mix.lang_pred <> 'und'").count() == 0


def test_chat_round_trip(spark):
    texts = ["</s>[INST] ok [/INST]", "\\", "\\\\<|end|>", "<|turn|>user<|text|>", None, "", "é" * 100_000, "[INST", "\n"]
    rows = [
        (c, t, ("user", "assistant", "system")[(c + t) % 3], texts[(c * 5 + t) % len(texts)])
        for c in range(6)
        for t in range(9)
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("part", F.lit(1))
    got = defaultdict(list)
    for r in sorted(chat.format_conversations(df, part_chars=50).collect(), key=lambda r: (r.conv_id, r.part)):
        got[r.conv_id].append(r)
    for c in range(6):
        turns, loss = [], "".join(chat.unescape(r.formatted[m.start : m.end]) for r in got[c] for m in r.marks)
        for kind, piece in chat.read_turns(r.formatted for r in got[c]):
            if kind == "role":
                turns.append([piece, ""])
            elif kind == "text":
                turns[-1][1] += piece
        want = [[r, t or ""] for k, _, r, t in rows if k == c]
        assert turns == want and loss == "".join(t for r, t in want if r == "assistant")


def test_templates():
    t = chat.Template(
        "{% if 1 + 1 == 2 %}{{ 'a' + 'b' }}{% else %}no{% endif %}{% for m in messages %}{% if loop.first %}<{% elif m.role == 'x' and not loop.last %}-{% else %}|{% endif %}{{ m.text | upper }}{% if loop.last %}>{% endif %}{% endfor %}"
    )
    assert t.tree[0] == chat.Emit(chat.Const("ab"))
    assert "".join(p for p, _ in t.render([{"role": "x", "text": c} for c in "abc"])) == "ab<A-B|C>"
    for bad in ("{% if x %}", "{{ m.__class__() }}", "{{ open }}{% endfor %}", "{{ 1 | eval }}", "{% import os %}"):
        with pytest.raises(chat.TemplateError):
            chat.Template(bad)
    with pytest.raises(chat.TemplateError):
        list(chat.Template("{{ open }}").render([]))


def test_secrets():
    model = secrets.Model(secrets.labelled(["thereationing", "retationerenst"]))
    kinds = lambda t: [(t[s:e], k) for s, e, k, _ in secrets.spans(t, model)]
    assert kinds("PassWord: token: abcdefg") == []  # the first match takes the second key word and is dropped
    assert kinds('x api_key="abcdef" AKIA' + "Z" * 16)[:2] == [('api_key="abcdef', "assign"), ("AKIA" + "Z" * 16, "access")]
    assert kinds("z" + "0a" * 12) == [("0a" * 12, "hex")]
    assert kinds("see ghR7xQ2mZp9LkWv4TnB8sYd3 now") == [("ghR7xQ2mZp9LkWv4TnB8sYd3", "random")]
    assert kinds("user_account_default_storage getDefaultAccountHandlerFactory") == [] == secrets.spans(None, model)
    held = secrets.labelled(n=2000, seed=99)
    assert sum((model.ratio(t) >= secrets.LEAST_RATIO) == bool(y) for t, y in held) >= 0.97 * len(held)


def test_secrets_of_letters_only():
    model = secrets.Model(secrets.labelled(["thereationing", "retationerenst"]))
    rng = random.Random(11)
    for letters, least in (
        ("abcdefghijklmnopqrstuvwxyz", 0.9),
        ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 0.99),
        ("abcdefghijklmnopqrstuvwxyz-_", 0.7)
    ):
        keys = ["".join(rng.choices(letters, k=32)) for _ in range(300)]
        assert (
            sum(
                [(4, 36, "random")] == [x[:3] for x in secrets.spans(f"see {t} now", model)] for t in keys
            ) >= least * len(keys)
        )
    held = secrets.labelled(n=2000, seed=99)
    assert sum(bool(secrets.spans(f"see {t} now", model)) == bool(y) for t, y in held) >= 0.97 * len(held)


def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES", 40)
    monkeypatch.setattr(topk, "QUERIES", 2)
    rng = np.random.default_rng(5)
    v = rng.normal(size=(300, 16)).round(1)
    v[100:140] = v[50]
    rows = [(i, [float(x) for x in v[i]]) for i in range(300)] + [
        (300, None), (350, [float("nan")] * 16), (351, [None] * 16), (352, []), (7, [float(x) for x in v[7]])
    ]
    df = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = sorted(map(tuple, topk.top_k(df.where("vec_id % 50 = 0"), df).collect()))
    q = np.floor(v * 256).astype(int)
    want = sorted(
        (i, r + 1, j, s)
        for i in range(0, 300, 50)
        for r, (s, j) in enumerate(
            sorted(((int(q[i] @ q[j]), j) for j in range(300) if j != i), key=lambda x: (-x[0], x[1]))[:5]
        )
    )
    assert got == want
    assert topk.top_k(df.limit(0), df).count() == 0


def test_top_k_keeps_repeated_rows(spark, monkeypatch, tmp_path):
    import duckdb

    monkeypatch.setattr(topk, "PIVOTS", 3)
    monkeypatch.setattr(topk, "CANDIDATES", 20)
    monkeypatch.setattr(topk, "QUERIES", 2)
    rng = np.random.default_rng(8)
    v = [[float(x) for x in r] for r in rng.normal(size=(120, 16)).round(1)]
    rows = (
        list(enumerate(v))
        + [(7, [30 * x for x in v[0]])]
        + [(9, [2 * x for x in v[50]])] * 8
        + [(50, v[3]), (100, v[100]), (11, v[3])]
    )
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    got = sorted(map(tuple, queries.op7_top_k(spark, str(tmp_path)).select("query_id", "rank", "vec_id", "score").collect()))
    assert got == sorted(con.execute(queries.ORACLES["op7_top_k"]).fetchall())
    assert {r[2] for r in got if r[0] == 0} >= {7} and sum(r[0] == 50 and r[2] == 9 for r in got) >= 2


def test_tokens_equal_the_library():
    tokens = packing.Tokens(queries.vocabulary_path())
    rng = random.Random(6)
    texts = [
        "",
        "a  b",
        " a",
        "a ",
        "x\n\ny z",
        "a \nb",
        "don't we'll 12 3!?",
        "日本 語",
        "<|endoftext|> hi",
        "a\tb c",
        "Œuvre",
        "q" * 5000,
        *(prose(rng, 50) + rng.choice([".", "\nÉté ", "###", " ¿qué? ñ"]) for _ in range(100))
    ]
    assert tokens.fast is not None
    for t in texts:
        assert tokens.encode(t) == np.array(tokens.whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


def test_added_tokens_equal_a_fresh_tokenizer():
    from tokenizers import Tokenizer

    tokens, fresh = packing.Tokens(queries.vocabulary_path()), Tokenizer.from_file(queries.vocabulary_path())
    assert fresh.encode("<|endoftext|> hi", add_special_tokens=False).ids == [50256, 23105]
    for t in (
        "<|endoftext|> hi",
        "a b<|endoftext|>c d",
        "one <|endoftext|><|endoftext|> two",
        "é <|endoftext|>",
        "日本 <|endoftext|>  x",
        "<|endoftext|",
        "endoftext|> a",
        "plain words only"
    ):
        assert np.frombuffer(tokens.encode(t), "<u4").tolist() == fresh.encode(t, add_special_tokens=False).ids


def test_packing(spark):
    rng = random.Random(7)
    texts = [*ODD, *(prose(rng, rng.randint(1, 900)) for _ in range(150))]
    tokens = packing.Tokens(queries.vocabulary_path())
    rows = packing.pack_documents(docs(spark, texts), queries.vocabulary_path()).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    total = 0
    for i, t in enumerate(texts):
        ids = tokens.encode(t or "") + (2).to_bytes(4, "little")
        own = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and sum(r.length for r in own) == len(ids) // 4
        assert (
            all(r.ids_crc32 == zlib.crc32(ids[4 * r.start : 4 * (r.start + r.length)]) for r in own)
            and all(r.length == 1024 for r in own[1:])
        )
        total += len(ids) // 4
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    assert len(by_seq) <= -(-total // 1024) + 1
    assert packing.pack_documents(docs(spark, texts).limit(0), queries.vocabulary_path()).count() == 0


def test_search_beats_best_fit():
    counts = {6: 2, 5: 2, 4: 2, 3: 3}  # best fit by decreasing length needs 5 sequences of 10 or fewer
    runs = packing.solve(counts, 10)
    assert sum(n for _, n in runs) == -(-sum(k * n for k, n in counts.items()) // 10)
    used = Counter()
    for p, n in runs:
        for k in p:
            used[k] += n
    assert used == counts


def test_licenses(spark):
    rows = [
        (0, "r/a/LICENSE", "Licensed under the Apache License, Version 2.0."),
        (1, "r/a/b/c/x.py", "no words about it"),
        (2, "r/y.py", "code here"),
        (3, "r/a/z.py", "code\nReleased under the MIT License.\nmore code here"),
        (4, None, None),
        (5, "r/a/b/LICENSE.txt", "Licensed under CC BY-NC 4.0."),
        (6, "r/a/w.py", ""),
        (7, "r/ab/v.py", "a licence to print money"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string")
    got = {r.doc_id: (r.license, r.origin, r.licensed_by) for r in licenses.scan(df, licenses.fit(df)).collect()}
    assert got == {
        0: ("Apache-2.0", "file", None),
        1: ("CC-BY-NC-4.0", "inherited", "r/a/b"),
        2: (None, "none", None),
        3: ("MIT", "header", None),
        4: (None, "none", None),
        5: ("CC-BY-NC-4.0", "file", None), 6: ("Apache-2.0", "inherited", "r/a"), 7: (None, "none", None),
    }


def test_whole_license_text_speaks_for_its_directory(spark):
    mit, bsd = (f"Copyright (c) 2020 The Authors\n\n{licenses.FILES[k]}" for k in ("MIT", "BSD-3-Clause"))
    long = "Licensed under the MIT License. " * 90
    rows = [
        (0, "a/one", mit),
        (1, "a/two", "code"),
        (2, "b/one", bsd),
        (3, "b/two", None),
        (4, "c/one", mit + " ".join(f" w{i}" for i in range(300))),
        (5, "c/two", "code")
    ]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string")
    model = licenses.fit(df)
    assert model.scan(long)[2] > 0  # more than 400 words are compared too
    got = {r.doc_id: (r.license, r.origin) for r in licenses.scan(df, model).collect()}
    assert (
        got == {
            0: ("MIT", "file"), 1: ("MIT", "inherited"), 2: ("BSD-3-Clause", "file"),
            3: ("BSD-3-Clause", "inherited"), 4: ("MIT", "header"), 5: (None, "none")
        }
    )


def test_word_hashes_do_not_cross_rows():
    from tidemark.llm.common import as_bytes, ascii_words, hashed_rows

    column = pa.array(["A b", None, "c", "", "a b B"])
    ((h, first),) = hashed_rows(map(ascii_words, as_bytes(column)))
    assert first.tolist() == [0, 2, 2, 3, 3, 5] and h[1] == h[4] and len(set(h.tolist())) == 4
    ((sliced, _),) = hashed_rows(map(ascii_words, as_bytes(column.slice(2))))
    assert sliced.tolist() == h[2:].tolist()


def test_words_that_collide_in_a_polynomial_hash_are_told_apart(spark):
    """Words of the Thue-Morse sequence and its complement have one polynomial hash modulo 2^64 for any base."""
    word = "".join("ab"[i.bit_count() % 2] for i in range(2048))
    other = word.translate({97: 98, 98: 97})
    got = {
        r.doc_id: (r.n_shingles, r.component_id)
        for r in jaccard.join(docs(spark, [f"p q {word} r s", f"p q {other} r s", f"P q {word} r\ts"])).collect()
    }
    assert got == {0: (1, 0), 1: (1, 1), 2: (1, 0)}


def test_pipeline_runs(spark):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert rows and {"doc_id", "sequence_id", "offset"} <= set(rows[0].asDict())
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "toxicity" and len(corpus_pipeline.STAGES) == 5


def test_pipeline_equals_plain_python_on_planted_cases(spark, tmp_path):
    import corpus_pipeline
    from tokenizers import Tokenizer

    rng = random.Random(13)
    item = " ".join(f"q{rng.randint(0, 5000)}" for _ in range(40))
    texts, want = [], {}
    for i in range(400):
        t = prose(rng, 60)
        if i % 4 == 0:  # toxic
            t += " horrid nasty! vilest horrid"
        elif i % 40 == 1:  # a near copy of the one two before, which stays
            t = texts[i - 2].rsplit(" ", 1)[0] + " other" if i > 2 and (i - 2) in want else t
        elif i % 40 == 2:  # holds a benchmark item
            t = f"{t} {item} {t}"
        elif i % 40 == 3:
            t += f" mail u{i}@h.org IBAN DE89 3704 0044 0532 0130 00 BIC <|endoftext|> ip 1.2.3.4"
        texts.append(t)
        if i % 4 and i % 40 != 2 and not any(
            len(sets_of(t) & sets_of(texts[j])) >= 0.75 * len(sets_of(t) | sets_of(texts[j]))
            for j in range(i)
            if j % 4
        ):
            want[i] = (
                t.replace(f"u{i}@h.org", "[EMAIL]")
                .replace("DE89 3704 0044 0532 0130 00", "[IBAN]")
                .replace("1.2.3.4", "[IP]")
            )
    assert 280 <= len(want) < 290
    spark.createDataFrame(
        [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)],
        "doc_id long, text string, lang string, source string, n_chars long"
    ).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(
        [(i, 1, int(i % 4 == 0)) for i in range(400)], "doc_id long, quality int, toxic int"
    ).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    fresh = Tokenizer.from_file(queries.vocabulary_path())
    ids = {i: np.array([*fresh.encode(t, add_special_tokens=False).ids, 2], "<u4") for i, t in want.items()}
    assert (
        {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows} == {
            (i, 0, 0, len(x), zlib.crc32(x.tobytes())) for i, x in ids.items()
        }
        and len(rows) == len(want)
    )
    by_seq = defaultdict(list)
    for r in rows:
        by_seq[r.sequence_id].append((r.offset, r.length))
    for own in by_seq.values():
        own.sort()
        assert (
            [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))]
            and sum(n for _, n in own) <= 1024
        )
