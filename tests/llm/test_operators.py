"""Edge cases and brute-force versions of the ten operators."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from volumetra.llm import bpe, flac, langid, licenses, lines, neardup, packing, passages, pii, quality

LONG = "word another third " * 20_000
EXTRA = ("x", "y", "text_key", "kept", "n", "words", "lo", "hi", "label", "key", "id", "media", "score", "gone", "_k")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and extra columns with the names that operators use."""
    rows = [(None, None), (None, "a null id with a text of more than ten words in it for sure"), (1, ""), (2, None), (3, "same text here for everybody to read and copy now ok yes"), (3, "same text here for everybody to read and copy now ok yes"),
            (4, LONG), (5, "same text here for everybody to read and copy now ok yes"), (6, "   \n\n \t"), (7, "é😀 a.b+c@d-e.fr 10.0.0.1 +1 (626) 555-0100 CC BY")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in EXTRA)
    return spark.createDataFrame([(*r, "en", "s", 1, *["z"] * len(EXTRA)) for r in rows], schema).cache()


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


def operators():
    import public_tokenizers as P

    words, ids = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.json")
    return {
        "licenses": licenses.scan,
        "lines": lines.dedup_lines,
        "langid": langid.cross_parse,
        "pii": pii.find,
        "sanitise": pii.sanitise,
        "flac": lambda d: flac.describe(flac.encode_column(d)),
        "packing": lambda d: packing.pack_documents(d, ids),
        "neardup": neardup.near_duplicates,
        "passages": passages.dedup_passages,
        "bpe": lambda d: bpe.digests(d, words),
        "bpe_columns": lambda d: bpe.encode_decode(d, words),
        "quality": quality.quality,
    }


@pytest.mark.parametrize("name", list(operators()))
def test_odd_rows(odd, name):
    out = operators()[name](odd)
    rows = out.collect()
    if name == "packing":
        assert {r["doc_id"] for r in rows} == {None, 1, 2, 3, 4, 5, 6, 7}
    else:
        assert len(rows) == 10
        same = [{k: v for k, v in r.asDict().items()} for r in rows if r["doc_id"] == 3]
        assert same[0] == same[1]


@pytest.mark.parametrize("name", list(operators()))
def test_empty_table(none, name):
    assert operators()[name](none).count() == 0


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_defined_results(odd):
    q = [r for r in quality.quality(odd).collect() if r["doc_id"] in (1, 2, 6)]
    assert all(r["base_failed"] and not r["kept"] and r["n_words"] == 0 for r in q)
    n = {(r["doc_id"], r["n_shingles"]): (r["component_id"], r["kept"]) for r in neardup.near_duplicates(odd).collect()}
    assert n[(5, 9)] == (3, False) and n[(3, 9)] == (3, True) and n[(1, 0)] == (1, True)
    p = by_id(passages.dedup_passages(odd.filter("doc_id is not null")))
    assert (p[3]["n_removed"], p[5]["n_removed"], p[1]["n_words"]) == (0, 0, 0)  # twelve words are no window
    lang = by_id(langid.cross_parse(odd.filter("doc_id is not null")))
    assert lang[1]["lang_pred"] == lang[2]["lang_pred"] == "und" and lang[1]["score"] == 0


# --- 1 ----------------------------------------------------------------------


def test_license_places(spark):
    texts = ["cc by", "CC-BY cc by", "all rights reserved. All Rights\nReserved", "the gnu general public license", "under the licensed under the apache license, version 2.0 ok", "licensed under the old apache license version 2 0", "by cc rights all"]
    out = by_id(licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    phrases = dict(licenses.BASE)
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())
        at = sorted((j, label) for p, label in phrases.items() for j in range(len(w)) if w[j : j + len(p.split())] == p.split())
        r = out[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None)
        assert r["base_labels"] == ",".join(sorted({x for _, x in at})) and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
    assert out[4]["labels"] == "apache-2.0" and 0 < out[5]["score"] < 1 and out[5]["labels"] == "apache-2.0" and out[6]["labels"] == ""


def test_altered_notices_beside_base_phrases(spark):
    bsd = "redistribution and use in source and binary forms with or without any modification are permitted"
    texts = ["licensed under the new GNU General Public License version 3", f"All rights reserved. {bsd}", "licensed under the gnu general public license version 2"]
    out = by_id(licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    assert [out[i]["labels"] for i in range(3)] == ["gpl,gpl-3.0", "bsd,reserved", "gpl,gpl-2.0"]


# --- 2 ----------------------------------------------------------------------


def test_fuzzy_lines(spark):
    base = "the quick brown fox jumps over the lazy dog near the quiet river bank while seven old men play cards under a large green tree beside the road every single sunny morning"
    near = base.replace("sunny", "sunnny")
    rows = [(1, f"{base}\nshort line"), (2, f"other words entirely stand in this line\n{base.upper()}!"), (3, f"{near}\nshort line"), (4, "nothing of that kind is in this text at all")]
    out = by_id(lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")))
    assert out[1]["text"] == rows[0][1] and out[2]["text"] == "other words entirely stand in this line" and out[4]["n_removed"] == 0
    assert out[2]["n_removed"] == 1 and out[3]["n_removed"] == 2 and out[3]["text"] == ""


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


def bit_distance(a, b):
    """Edit distance by columns of bits (the usual recurrence; whole columns at once)."""
    places, ones = {}, (1 << len(a)) - 1
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    up, down, n, top = ones, 0, len(a), 1 << (len(a) - 1)
    for c in b:
        eq = places.get(c, 0)
        x = (((eq & up) + up) ^ up) | eq | down
        plus, minus = down | (~(x | up) & ones), up & x
        n += bool(plus & top) - bool(minus & top)
        plus, minus = (plus << 1 | 1) & ones, (minus << 1) & ones
        up, down = minus | (~((eq | down) | plus) & ones), plus & (eq | down)
    return n


def test_bit_distance():
    rng = random.Random(23)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(1, 12))) for _ in range(2))
        assert bit_distance(a, b) == edit_distance(a, b)


def test_near_lines_are_candidates(spark):
    """Pairs at 0.8 edit similarity or more, by brute force, share a key; three bits of a SimHash passed few of them."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 9)))
    pairs = []
    while len(pairs) < 200:
        a = [word() for _ in range(rng.choice([6, 10, 20, 30]))]
        if len(pairs) % 4 == 3:
            a = ["".join(chr(0x4E00 + rng.randrange(2000)) for _ in range(40))]  # a script without spaces
            b = ["".join(c if i != 20 else "x" for i, c in enumerate(a[0]))]
        else:
            b = [word() if rng.random() < 0.12 else w for w in a]
        x, y = " ".join(a), " ".join(b)
        if x != y and edit_distance(x, y) <= max(len(x), len(y)) // 5:
            pairs.append((x, y))
    df = spark.createDataFrame([(2 * i + k, p[k]) for i, p in enumerate(pairs) for k in (0, 1)], "id long, norm string")
    keys = {}
    for r in lines.line_keys(df.select("id", lines.sketch(df["norm"]).alias("s")).select("id", "s.*")).collect():
        keys.setdefault(r["id"], set()).add(r["key"])
    found = sum(bool(keys[2 * i] & keys[2 * i + 1]) for i in range(len(pairs)))
    assert found >= 0.95 * len(pairs), found
    assert not any(keys[2 * i] & keys[2 * i + 2] for i in range(len(pairs) - 1))


def test_keys_of_a_turn(spark):
    df = spark.createDataFrame([(1, "one two three four five six seven eight"), (2, "ab cd efg hi jk"), (3, "日本語の文章はここにあります"), (4, "abcdefghi")], "id long, norm string")
    df = df.select("id", lines.sketch(df["norm"]).alias("s")).select("id", "s.*")
    rows = lambda x: sorted(map(tuple, x.collect()))
    every = rows(lines.line_keys(df))
    assert every == sorted(rows(lines.line_keys(df, 0, 2)) + rows(lines.line_keys(df, 1, 2))) and len({i for _, i in every}) == 4
    assert sum(i == 1 for _, i in every) == 15
    turn = dict(rows(lines.line_keys(df, 1, 2)))
    assert not any(k in turn for k, _ in rows(lines.line_keys(df, 0, 2)))  # a key has one turn, whichever words it is made of


def test_lines_meet_at_one_shared_key(spark):
    rng = random.Random(24)
    norms = []
    for i in range(40):
        a = sentence(rng, rng.choice([2, 5, 8, 20])).split()
        norms += [" ".join(a), " ".join(sentence(rng, 1) if rng.random() < 0.1 else w for w in a)]
    df = spark.createDataFrame(list(enumerate(norms)), "id long, norm string").select("id", lines.sketch(F.col("norm")).alias("s")).select("id", "s.*")
    keys = {}
    for r in lines.line_keys(df).collect():
        keys.setdefault(r["id"], set()).add(r["key"])
    one, two = df.select(F.struct("*").alias("a")), df.select(F.struct("*").alias("b"))
    met = one.join(two, F.col("a.id") < F.col("b.id")).select("a.id", F.col("b.id").alias("other"), lines.shared_key(F.col("a"), F.col("b")).alias("k")).collect()
    assert all((r["k"] in keys[r["id"]] & keys[r["other"]]) == bool(keys[r["id"]] & keys[r["other"]]) for r in met) and any(keys[2 * i] & keys[2 * i + 1] for i in range(40))


def test_lines_by_brute_force(spark):
    """Every line of the smallest tables: what goes is all but the first of each group of lines that are alike."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    seen = {}
    for r in lines.line_texts(docs).collect():
        seen.setdefault(r["norm"], []).append((r["doc_id"], r["at"]))
    norms = sorted(seen, key=len)
    root = {n: n for n in norms}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    bags = [np.bincount(np.frombuffer(n.encode("utf-32-le"), np.uint32) % 97, minlength=97) for n in norms]
    for j, y in enumerate(norms):
        allowed = len(y) // 5
        for i in range(j - 1, -1, -1):
            x = norms[i]
            if len(y) - len(x) > allowed or len(x) < lines.MIN_CHARS:
                break
            if np.abs(bags[i] - bags[j]).sum() <= 2 * allowed and find(x) != find(y) and bit_distance(x, y) <= allowed:
                root[find(y)] = find(x)
    groups = {}
    for n in norms:
        groups.setdefault(find(n), []).extend(seen[n])
    want = {}
    for places in groups.values():
        for d, at in sorted(places)[1:]:
            want.setdefault(d, []).append(at)
    got = by_id(lines.dedup_lines(docs))
    wrong = [d for d, r in got.items() if r["n_removed"] != len(want.get(d, ()))]
    assert not wrong and len(got) == docs.count() and sum(map(len, want.values())) > 100


def letters_apart(x, y):
    row = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        before, row[0] = row[0], i
        for j, b in enumerate(y, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (a != b))
    return row[-1]


def test_lines_are_normalised_once(spark):
    """Rare letters and digits are known whichever way a line goes, and no text is split or searched twice."""
    import unicodedata

    odd = ["ÀÉ ß  ½x ²  Ⅳ ⓐ İstanbul ΑΣ", " 12 ab", "123456789 12", "\t.. ", "٣٤٥ abcdefgh ٣", "中文 字符 中文字符 中文字符", "𝐀𝐁 text here 𝟘", "ªº ab\u0345cdefghijk", "x y abcdefgh\r", "a" * 5 + " " * 40 + "bcdefg,,;!h"]
    kind = lambda c: unicodedata.category(c)[0]
    want = {}
    for at, line in enumerate(odd):
        norm = " ".join("".join(c if kind(c) in "LN" else " " for c in line.lower()).split(" ")).split()
        norm = " ".join(norm)
        if norm:
            want[at] = "".join("0" if kind(c) == "N" else c for c in norm) if len(norm) >= lines.MIN_CHARS else norm
    out = lines.line_texts(spark.createDataFrame([(1, "\n".join(odd)), (2, None)], "doc_id long, text string"))
    assert {r["at"]: r["norm"] for r in out.collect()} == want
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(coalesce(") == 1 and plan.count("mask(") == 1


def test_keys_of_whole_sketches(spark):
    """Whole, short and piece sketches have a key for each so many of their hashes."""
    from itertools import combinations

    rows = [(1, list(range(6)), True), (2, list(range(5)), True), (3, [1, 2], True), (4, list(range(7)), False), (5, [7], False)]
    df = spark.createDataFrame(rows, "id long, sketch array<long>, words boolean")
    sets = [(i, list(c)) for i, s, w in rows for c in (combinations(s, 4 if w else 3) if len(s) >= (4 if w else 3) else [s])]
    want = {(r["id"], r["key"]) for k in {len(c) for _, c in sets} for r in spark.createDataFrame([(i, c) for i, c in sets if len(c) == k], "id long, c array<long>").select("id", F.xxhash64(*[F.col("c")[j] for j in range(k)]).alias("key")).collect()}
    got = lines.line_keys(df)
    assert {(r["id"], r["key"]) for r in got.collect()} == want
    # the keys of whole sketches are made without a condition
    assert any("explode(array(xxhash64(" in x for x in got._jdf.queryExecution().optimizedPlan().toString().split("\n"))


def test_long_lines_by_parts(spark, monkeypatch):
    """The sum over parts is never below the distance by letters, near it for near lines, and what it tells is what letters tell."""
    monkeypatch.setattr(lines, "LONG_LINE", 300)
    r = random.Random(5)
    words = ["".join(r.choices("abcdefghijé", k=r.randint(1, 9))) for _ in range(80)]
    pairs = []
    for share in (0.0, 0.05, 0.1, 0.2, 0.3, 1.0):
        for base in (r.choices(words, k=110), ["osas"] * 120, ["ab", "cde", "f"] * 50):
            near = [w if r.random() >= share else r.choice(words) for w in base if r.random() >= share / 3]
            pairs += [(" ".join(base), " ".join(near)), (" ".join(base), " ".join(near[len(near) // 8 :]))]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, x string, y string")
    a, b = (F.struct(F.col(c).alias("norm"), F.length(c).alias("size")) for c in "xy")
    df = df.withColumn("a", a).withColumn("b", b)
    a, b = F.col("a"), F.col("b")
    told = 0
    for row in df.select("i", lines.parts_distance(a, b).alias("d"), lines.allowed(a, b).alias("most"), lines.settled(a, b).alias("same")).collect():
        true = letters_apart(*pairs[row["i"]])
        assert row["d"] >= min(true, row["most"] + 1) and row["same"] == (true <= row["most"])
        told += row["d"] <= row["most"]
    assert told > 12


def test_blocks_of_lines_are_bounded_by_letters(spark, monkeypatch):
    """Long lines of the same words in another order meet at every key: they are dealt to more than one block, and stay."""
    monkeypatch.setattr(lines, "BLOCK_LETTERS", 2000)
    r, blocks, save = random.Random(3), [], lines.Scratch.save
    words = ["".join(r.choices("abcdefghij", k=7)) for _ in range(60)]

    def seen(self, df, name, *args, **more):
        out = save(self, df, name, *args, **more)
        if name == "blocks":
            blocks.extend(out.collect())
        return out

    monkeypatch.setattr(lines.Scratch, "save", seen)
    rows = [(i, " ".join(r.sample(words, 60))) for i in range(12)]
    out = by_id(lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")))
    assert sum(len(v["text"]) for v in out.values()) == sum(len(t) for _, t in rows)
    assert blocks and all(b["nb"] > 1 for b in blocks)


def test_near_lines_are_removed(spark):
    rng = random.Random(12)
    base = " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(20))
    near = base.replace(base.split()[7], "zzzzz").replace(base.split()[14], "yyyyy")
    out = by_id(lines.dedup_lines(spark.createDataFrame([(1, base), (2, near)], "doc_id long, text string")))
    assert [out[i]["n_removed"] for i in (1, 2)] == [0, 1]


def test_letters_decide(spark):
    """Not the share of words that differ: that is large where each of them differs by a letter, and misses what is just too far."""
    rng = random.Random(31)
    word = lambda n, of: "".join(rng.choice(of) for _ in range(n))
    far = []
    for i in range(12):
        a = [word(11, "abcdefghijklm") for _ in range(40)]
        gone = rng.sample(range(40), 9)
        far.append((" ".join(a), " ".join(word(11, "nopqrstuvwxyz") if k in gone else w for k, w in enumerate(a))))
    long = [word(9, "abcdefghijklm") for _ in range(8)]
    short = [word(4, "abcdefghijklm") for _ in range(40)]
    near = (" ".join(long + short), " ".join(long + [w[:3] + "z" for w in short]))
    rows = [(2 * i + k, p[k]) for i, p in enumerate([*far, near]) for k in (0, 1)]
    out = by_id(lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")))
    for i, (x, y) in enumerate([*far, near]):
        assert out[2 * i]["n_removed"] == 0 and out[2 * i + 1]["n_removed"] == (5 * edit_distance(x, y) <= max(len(x), len(y))), i
    assert out[25]["n_removed"] == 1


def test_long_lines_and_numbers(spark):
    rng = random.Random(13)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(70)]
    rows = [(1, " ".join(words)), (2, " ".join("zzzzzz" if i % 14 == 7 else w for i, w in enumerate(words))), (3, "page 12 of the yearly report 2019"), (4, "page 98 of the yearly report 2020")]
    out = by_id(lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")))
    assert len(rows[0][1]) > 400 and [out[i]["n_removed"] for i in (1, 2, 3, 4)] == [0, 1, 0, 1]


def test_short_lines(spark):
    rows = [(1, "Home\nAbout us\n1\n---\n\n日本語"), (2, "home\nabout us!\n2\n---\n\n日本語")]
    out = by_id(lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")))
    assert out[1]["text"] == rows[0][1] and out[2]["text"] == "2\n---\n" and out[2]["n_removed"] == 3


# --- 3 ----------------------------------------------------------------------


def phrases(text, sample):
    n = p = 0
    while p < len(text):
        k = 0
        while p + k < len(text) and text[p : p + k + 1] in sample:
            k += 1
        p, n = p + max(1, k), n + 1
    return n


def test_cross_parsing_counts():
    samples = {"a": "abcabcab", "b": "hello world"}
    m = langid.Model(samples)
    rng = random.Random(2)
    for _ in range(60):
        t = langid.normal("".join(rng.choice("abchelo wz") for _ in range(40)))
        s = m.symbols(t)
        lanes = np.full((langid.SEGMENT, 1), langid.PAD, np.int32)
        lanes[: len(s), 0] = s
        for name, a in zip(m.names, m.automata):
            assert not t or a.phrases(lanes)[0] == phrases(t, samples[name])


def test_held_out_accuracy(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = langid.cross_parse(d).join(d.select("doc_id", "lang"), "doc_id").filter("held_out").selectExpr("avg(cast(lang = lang_pred as double)) a", "count(*) n").first()
    assert r["n"] > 100 and r["a"] > 0.95


# --- 4 ----------------------------------------------------------------------

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum((int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10))) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(t):
    out = []
    for k, p in PLAIN.items():
        for m in re.finditer(p, t or ""):
            d = re.sub("[^0-9]", "", m.group())
            if {"email": True, "ip": k == "ip" and all(int(x) <= 255 for x in m.group().split(".")), "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[k]:
                out.append(f"{k}:{m.start()}:{m.end()}")
    return out


def test_base_spans_are_the_plain_patterns(spark):
    rng = random.Random(3)
    texts = ["a@b.c_d@e.f 1.2.3.4.5.6.7.8 x@y.z@q.r.s", "4111 1111 1111 1111", "é😀 a.b+c@d-e.f.g. 300.1.1.1 0255.1.1.1", "a..@b a@@b.c %@-.-.. .", "+1 (626) 555-0100", None, ""]
    texts += ["".join(rng.choice(["a", "@", ".", "1", "4111111111111111", "+", "7", " ", "-", "(", "é", "x.y", "_", "255", "\n"]) for _ in range(100)) for _ in range(60)]
    out = by_id(pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    for i, t in enumerate(texts):
        b = base_spans(t)
        assert out[i]["base_sha256"] == hashlib.sha256(",".join(b).encode()).hexdigest(), t
        assert [x for x in out[i]["spans"].split(",") if x and not x.startswith("term")] == b
        assert [out[i][f"n_{k}"] for k in PLAIN] == [sum(x.startswith(k + ":") for x in b) for k in PLAIN]


def sentence(rng, n=14):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(4, 9))) for _ in range(n))


def test_disclosing_terms(spark):
    rng = random.Random(31)
    rows = [(i, f"{sentence(rng)} Zebulon {sentence(rng)} call zeb@corp.example please, zebulon") for i in range(20)]
    rows += [(100 + i, f"call someone {sentence(rng)} please and write to p{i}@corp.example") for i in range(60)]
    rows += [(200, f"zebulon {sentence(rng)}")]  # the name without the address
    out = by_id(pii.find(spark.createDataFrame(rows, "doc_id long, text string")))
    for i, t in rows[:20]:
        at = [m.start() for m in re.finditer("(?i)zebulon", t)]
        assert [x for x in out[i]["spans"].split(",") if x.startswith("term")] == [f"term:{a}:{a + 7}" for a in at]  # far from the address too
    assert all(r["n_term"] == 0 for i, r in out.items() if i >= 100)  # common words tell nothing, nor does a name alone
    clean = by_id(pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")))
    assert "ebulon" not in clean[0]["text"] and "[EMAIL]" in clean[0]["text"] and "[EMAIL]" in clean[100]["text"] and "zebulon" in clean[200]["text"]


def test_versions_of_a_text_are_one_witness(spark):
    """Words that an address shares with its own copies alone are no terms, however many copies there are."""
    rng = random.Random(32)
    base = sentence(rng, 40)
    rows = [(i, f"{base} mail me at jo@corp.example {sentence(rng, 1)}") for i in range(40)] + [(100 + i, sentence(rng)) for i in range(40)]
    out = by_id(pii.find(spark.createDataFrame(rows, "doc_id long, text string")))
    assert all(r["n_email"] == (i < 100) and r["n_term"] == 0 for i, r in out.items())


def test_disclosure_by_brute_force(spark):
    """Counts, versions, Wilson's bound and places against loops over a small corpus of few words."""
    rng = random.Random(33)
    names, words = ["ann", "bob", "cid"], [f"word{i}" for i in range(12)] + ["Xerxes", "Ymir", "Zoe9"]
    rows = []
    for i in range(150):
        who = rng.choice([*names, None, None])
        hint = {"ann": "Xerxes", "bob": "Ymir", "cid": "Zoe9"}.get(who) if rng.random() < 0.8 else rng.choice(words)
        body = [rng.choice(words[:12]) for _ in range(rng.randrange(3, 9))] + [f"u{i}x{j}" for j in range(12)] + ([hint] if hint else [])
        rng.shuffle(body)
        rows.append((i, " ".join(body) + (f" to {who}@corp.example." if who else "")))
    rows += [(500, rows[0][1]), (500, rows[0][1])]
    spark_hash = {r["w"]: r["h"] for r in spark.createDataFrame([(w,) for _, t in rows for w in re.split(pii.NOT_WORD.replace("\\p{L}\\p{N}", "a-z0-9"), t.lower())], "w string").distinct().selectExpr("w", "xxhash64(w) h").collect()}
    terms = lambda t: {w for w in re.split("[^a-z0-9]+", t.lower()) if len(w) >= 4 and re.search("[a-z]", w)}
    version = lambda t: min(spark_hash[w] for w in terms(t))
    holders = {n: [t for _, t in rows if f" {n}@corp" in t] for n in names}
    told = {}
    for n, texts in holders.items():
        for w in set().union(*map(terms, texts)):
            k = [version(t) for t in texts if w in terms(t)]
            share = len(k) / sum(w in terms(t) for _, t in rows)
            size = len(k) ** 2 / sum(k.count(v) ** 2 for v in set(k)) / share
            z = 1.96**2
            low = (share + z / 2 / size - 1.96 * (share * (1 - share) / size + z / 4 / size**2) ** 0.5) / (1 + z / size)
            if low >= 0.5 and len(set(k)) >= 4:
                told[n, w] = low
    assert told
    out = by_id(pii.find(spark.createDataFrame(rows, "doc_id long, text string")))
    for i, t in rows:
        mine = {w for (n, w) in told if f" {n}@corp" in t}
        taken = [m.span() for m in re.finditer(PLAIN["email"], t)]
        want = [f"term:{m.start()}:{m.end()}" for m in re.finditer("[A-Za-z0-9]+", t) if m.group().lower() in mine and not any(a < m.end() and m.start() < b for a, b in taken)]
        assert [x for x in out[i]["spans"].split(",") if x.startswith("term")] == want, (i, t)


# --- 5 ----------------------------------------------------------------------


def test_flac_round_trip():
    rng = random.Random(4)
    texts = ["", None, "a" * 576, "é" * 3000, LONG[:9000]] + ["".join(chr(rng.choice([65, 200, 0x4E00 + rng.randrange(9000), 0x1F600])) for _ in range(900)) for _ in range(8)]
    pay = [flac.payload(t)[1] for t in texts]
    media = flac.write_streams(pay)
    assert flac.read_streams(media) == pay and all(len(p) % 576 == 0 and p for p in pay)
    head = flac.parse(media[4])
    assert flac.frame_bounds(media[4], head["starts"][0]) == head["starts"]  # as without the seek table
    a, b = head["starts"][:2]
    assert bytes(x + 128 for x in flac.read_subframe(media[4][a + 6 : b - 2], 576, 8)) == pay[4][:576]  # bit by bit


def test_flac_damage():
    media = bytearray(flac.write_streams([flac.payload(LONG[:3000])[1]])[0])
    media[-10] ^= 4
    with pytest.raises(ValueError, match="CRC-16"):
        flac.read_streams([bytes(media)])


def test_flac_subframe_forms():
    order = lambda n: (0x08 | n) << 1
    bits = f"{order(1):08b}" + f"{5:08b}" + "00" + "0001" + "0000" + "1" * 1 + "0001" + "10" + "0101"
    # order 1, warm-up 5, two partitions of two samples: Rice 0 with residual 0, then Rice 1 with residuals 0 and -1
    data = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    got = flac.read_subframe(data, 4, 8)
    assert got[0] == 5 and len(got) == 4


def test_pcm_blocks(spark):
    d = spark.createDataFrame([(1, "x" * 1500)], "doc_id long, text string")
    rows = flac.pcm_blocks(flac.encode_column(d)).orderBy("block").collect()
    assert [r["sample_offset"] for r in rows] == [0, 576, 1152] and b"".join(bytes(r["pcm"]) for r in rows) == flac.payload("x" * 1500)[1]


# --- 6 ----------------------------------------------------------------------


def test_fullest_combination():
    rng = random.Random(5)
    for _ in range(100):
        counts = {rng.randrange(1, 40): rng.randrange(1, 3) for _ in range(rng.randrange(1, 6))}
        got = packing.fullest(counts, 60)
        items = [k for k, n in counts.items() for _ in range(n)]
        items.remove(max(counts))
        sums = {max(counts)}
        for x in items:
            sums |= {s + x for s in sums if s + x <= 60}
        assert sum(k * n for k, n in got.items()) == max(sums) and all(n <= counts[k] for k, n in got.items())


def test_packing_is_whole(spark):
    import public_tokenizers as P

    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = packing.pack_documents(d, P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")).collect()
    tok = bpe.load(P.path("byte_bpe_50k.json"))
    ids = {r["doc_id"]: [*tok.encode(r["text"], add_special_tokens=False).ids, 2] for r in d.collect()}
    bins, pieces = {}, {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        pieces.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 1024
    for k, v in ids.items():
        part = sorted(pieces[k])
        assert [p[0] for p in part] == list(range(len(part))) and sum(p[2] for p in part) == len(v) and (len(v) > 1024 or len(part) == 1)
        assert all(p[2] == 1024 for p in part[1:]) and all(zlib.crc32(np.array(v[s : s + n], "<u4").tobytes()) == c for _, s, n, c in part)
    total = sum(map(len, ids.values()))
    assert len(bins) <= 1.02 * -(-total // 1024) + 1


# --- 7 and 8 ----------------------------------------------------------------


def groups(rows, k=4):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(sets)
    for a in keys:
        for b in keys:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def copies(n, edits, seed, words=120):
    rng = random.Random(seed)
    base = [f"v{rng.randrange(400)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits)):
            w[rng.randrange(words)] = f"q{rng.randrange(9999)}"
        out.append(" ".join(w))
    return out


def test_near_duplicates_match_all_pairs(spark):
    """A large group of near copies too: buckets of more than one block, with links that the star alone does not find."""
    texts = copies(150, 12, 1) + copies(30, 3, 2) + ["", "a b c", "A b C", "a b"] + [f"alone {i} in the corpus with words {i * 7}" for i in range(20)]
    rows = list(enumerate(texts))
    out = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == groups(rows)


def test_hamming_index_finds_all_within_reach():
    """Signatures that differ in REACH slots, wherever they are, share a key."""
    rng = random.Random(6)
    for _ in range(200):
        wrong = set(rng.sample(range(neardup.SLOTS), neardup.REACH))
        assert any(len(wrong & set(range(3 * c, 3 * c + 3))) <= 1 for c in range(neardup.CHUNKS))


def test_passages_match_all_windows(spark):
    rng = random.Random(7)
    rows = [(i, " ".join(f"w{rng.randrange(3)}" for _ in range(rng.randrange(0, 50)))) for i in range(120)]
    rows += [(200 + i, " ".join([f"a{i}", *[f"p{j}" for j in range(20)], f"b{i}", *[f"u{i}.{j}" for j in range(15)]])) for i in range(30)]
    rows += [(300, rows[-1][1]), (301, rows[-1][1])]
    words = {i: t.split() for i, t in rows}
    low = {}
    for i, w in words.items():
        for j in range(len(w) - 12):
            k = tuple(w[j : j + 13])
            low[k] = min(low.get(k, i), i)
    out = by_id(passages.dedup_passages(spark.createDataFrame(rows, "doc_id long, text string"), n_batches=5))
    for i, w in words.items():
        gone = {x for j in range(len(w) - 12) if low[tuple(w[j : j + 13])] < i for x in range(j, j + 13)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        assert (out[i]["n_words"], out[i]["n_removed"], out[i]["kept"]) == (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()), i


BATCHES = [[1, 2], [2, 3], [3, 4], [1, 9], [4, 5, 9], [7]]
SHARED = [set(), {2}, {3}, {1}, {4, 9}, set()]


def batch(spark, k):
    return spark.createDataFrame([(f, k) for f in BATCHES[k]], "fp long, doc_id long")


def test_index_runs_compact(spark):
    from volumetra.llm.common import Scratch

    scratch = Scratch(spark, "t")
    index = passages.FingerprintIndex(spark, scratch.path("index"))
    levels = []
    for k, want in enumerate(SHARED):
        assert {r["fp"] for r in index.append(batch(spark, k), scratch).collect()} == want
        levels.append(sorted(r[0] for r in index.runs))
    assert levels == [[0], [0, 0], [0, 1], [0, 0, 1], [0, 2], [0, 0, 2]]
    assert {r["fp"]: (r["lo"], r["hi"]) for r in index.read(max(index.runs)).collect()}[1] == (0, 3)
    index.close(keep=False)
    assert not spark.catalog.listTables(pattern=f"fingerprints_{index.id}*")


def test_index_opens_again(spark):
    """One index, closed and opened between batches, and a run that was never finished beside it."""
    from volumetra.llm.common import Scratch

    scratch = Scratch(spark, "t")
    folder = scratch.path("index")
    spark.range(3).selectExpr("id as fp", "-id as lo", "id as hi").write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{folder}/run-0-90-4")
    for k, want in enumerate(SHARED):
        index = passages.FingerprintIndex(spark, folder)
        assert {r["fp"] for r in index.append(batch(spark, k), scratch).collect()} == want
        index.close()


def test_no_shuffle_between_runs(spark):
    from volumetra.llm.common import Scratch

    scratch = Scratch(spark, "t")
    index = passages.FingerprintIndex(spark, scratch.path("index"))
    for k in (0, 1):
        index.append(batch(spark, k), scratch)
    one, two = (index.read(r) for r in index.runs)
    plan = one.join(two.hint("merge"), "fp")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    index.close()


# --- 9 ----------------------------------------------------------------------


def test_tree_equals_the_library():
    import public_tokenizers as P

    units = bpe.WordUnits(P.path("word_bpe_49k.json"))
    rng = random.Random(8)
    texts = ["", None, "<|endoftext|> a<|endoftext|>b", "a  b\n\n c\t\td e\xa0f g ", "İSTANBUL ΣΑΣ é́x", "日本語テキスト" * 120, "x" * 700 + "!" * 600 + "'s" * 300]
    texts += ["".join(rng.choice(["th", "e", "'s", "9", "!", "é", "Zz", "_", "ing", "日", "'re", "ou"]) for _ in range(rng.randrange(300, 1500))) for _ in range(25)]
    for t in texts:
        e = units.tok.encode(t or "", add_special_tokens=False).ids
        ids, text = units.encode(t)
        assert ids == np.array(e, "<u4").tobytes() and text == units.tok.decode(e, skip_special_tokens=False)


def test_byte_units_equal_the_library():
    import public_tokenizers as P

    units = bpe.ByteUnits(P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"))
    for t in ["a b\nc d's 12", " a", "a  b", "a\n\nb", "x\ty", "é è<|endoftext|>z", "tail \n", "one\ntwo three"]:
        assert units.encode(t) == np.array(units.tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t


# --- 10 ---------------------------------------------------------------------


def test_quality_counts(spark):
    rng = random.Random(9)
    texts = ["a b c d e f a b c d e", "one two\n one two\none two\n\n", "# $ x\x0by", "Ω€ 😀 z", " ".join(f"w{rng.randrange(4)}" for _ in range(300))] + ["\n".join(" ".join(rng.choice("ab|>*") for _ in range(6)) for _ in range(9)) for _ in range(10)]
    out = by_id(quality.quality(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        at = {}
        for j in range(len(w) - 4):
            at.setdefault(tuple(w[j : j + 5]), []).append(j)
        rep = len({x for js in at.values() if len(js) > 1 for j in js for x in range(j, j + 5)})
        ls = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = out[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(ls) - len(set(ls)), rep)
        assert r["base_failed"] == (len(w) < 10 or 100 * rep > 20 * len(w)) and not (r["base_failed"] and r["kept"])


def test_line_rules(spark):
    clean = "A sentence that is clean and says something of its own to its readers."
    text = f"{clean}\nHome | News | Sport | Shop | Login\nWe use it: see our cookie policy.\n{clean} Again."
    r = quality.quality(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert r["clean_text"] == f"{clean}\n{clean} Again."


# --- batches over the size at which they are sliced ---------------------------


def test_words_of_a_slice():
    import pyarrow as pa

    from volumetra.llm.common import word_lists

    whole = pa.array(["AbC d", None, "Déf GH", "xYz", "", "QQ rr SS"])
    for a in range(len(whole)):
        flat, offsets = word_lists(whole.slice(a), lower=True)
        expect = [(t or "").lower().split() for t in whole.to_pylist()[a:]]
        assert [flat.to_pylist()[i:j] for i, j in zip(offsets[:-1], offsets[1:])] == expect


@pytest.mark.parametrize("name", [n for n in operators() if n not in ("licenses", "lines", "pii", "sanitise", "quality")])
def test_sliced_batches(spark, name):
    """One Arrow batch of 9 MB, cut into slices, gives what rows alone in their batches give."""
    rng = random.Random(21)
    words = ["".join(rng.choice("aeioubdfgklmnprst") for _ in range(rng.randrange(2, 9))) for _ in range(3000)]
    base = [" ".join(rng.choice(words).title() for _ in range(33_000)) for _ in range(28)]
    texts = base + [base[3], base[20] + " Tail", None, "", base[9][:1000] + base[27][-1000:]]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    run = operators()[name]
    rows = lambda d: sorted(map(str, run(d).drop("sequence_id", "offset").collect()))
    assert rows(docs.coalesce(1)) == rows(docs.repartition(len(texts)))


# --- joins that many rows share -------------------------------------------------


def test_filtered_semi_join(spark):
    """Beyond the broadcast bound a filter of bits goes first; no row is lost and none is too many, nulls included."""
    from volumetra.llm.common import only

    df = spark.range(20_000).selectExpr("nullif(id % 7000, 13) as doc_id", "id")
    ids = spark.range(0, 7000, 3).selectExpr("nullif(id, 12) as doc_id")
    rows = lambda d: sorted(r["id"] for r in d.collect())
    small, large = only(df, ids, "doc_id", 2334), only(df, ids, "doc_id", 10**9)
    assert rows(small) == rows(large) and len(rows(small)) > 6000
    assert "_bits" in large._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join(spark, monkeypatch, how):
    from volumetra.llm import common

    monkeypatch.setattr(common, "HOT_LEAST", 50)
    df = spark.range(3000).selectExpr("case when id % 3 = 0 then 1 when id % 3 = 1 then id else null end as k", "id")
    side = df.filter("k is not null").groupBy("k").agg(F.count("*").alias("n")).filter("k % 2 = 1").withColumn("x", F.col("k") * 10)
    got = common.salted_join(df, side, "k", "id", 3000, how)
    want = df.join(side.drop("n"), "k", how)
    rows = lambda d: sorted(map(str, d.select("k", "id", "x").collect()))
    assert rows(got) == rows(want) and "_salt" in got._jdf.queryExecution().optimizedPlan().toString()


def test_components_by_brute_force(spark):
    from volumetra.llm import linkage
    from volumetra.llm.common import Scratch

    rng = random.Random(41)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, 600 + i) for i in range(80)] + [(rng.randrange(1000, 1300), rng.randrange(1000, 1300)) for _ in range(200)] + [(7, 7)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    want = {x: find(x) for x in root if find(x) != x}
    df = spark.createDataFrame(edges, "a long, b long").repartition(5)
    before = linkage.LOCAL_EDGES, linkage.FEW_EDGES
    for native, local, few in ((True, 0, 10**6), (True, 0, 0), (False, 10**6, 0), (False, 40, 0), (False, 40, 10**6)):
        linkage.LOCAL_EDGES, linkage.FEW_EDGES = local, few
        out = linkage.components(df, Scratch(spark, "t"), native).collect()
        linkage.LOCAL_EDGES, linkage.FEW_EDGES = before
        assert {r["id"]: r["root"] for r in out} == want and len(out) == len(want)


def test_license_sql_has_the_operators_rivals(spark):
    import duckdb
    import pandas as pd

    from volumetra.llm.oracles import ORACLES

    bsd = "redistribution and use in source and binary forms with or without any modification are permitted"
    texts = ["licensed under the new GNU General Public License version 3", f"All rights reserved. {bsd}", "licensed under the gnu general public license version 2 or 3", "cc by", "", None, "released under the mit license, licensed under the apache license version 2.0"]
    documents = pd.DataFrame({"doc_id": range(len(texts)), "text": texts})  # noqa: F841
    want = {r[0]: r for r in duckdb.sql(f"SELECT doc_id, n_words, n_base, first_word, last_word, base_labels, labels, round(score, 9) FROM ({ORACLES['op1_license_scan']})").fetchall()}
    for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        assert (*tuple(r)[:7], round(r["score"], 9)) == want[r["doc_id"]]
