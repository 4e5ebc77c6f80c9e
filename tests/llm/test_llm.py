"""The training-data operators against brute force, on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from tierlake.llm import op1_best_fit_packing as op1
from tierlake.llm import op2_license_scans as op2
from tierlake.llm import op3_suffix_array_dedup as op3
from tierlake.llm import op4_url_filters as op4
from tierlake.llm import op5_quality_rules as op5
from tierlake.llm import op6_minhash_near_dedup as op6
from tierlake.llm import op7_benchmark_decontamination as op7
from tierlake.llm import op8_substring_dedup as op8
from tierlake.llm import op9_quality_classifier as op9
from tierlake.llm import op10_line_dedup as op10
from tierlake.llm import repeats
from tierlake.llm.common import real_id
from tierlake.llm.components import components
from tierlake.llm.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k string, h string, n int, line string, anchor string, __k string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(n))


def corpus():
    rng = random.Random(5)
    base = [sentence(rng, 90) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100 + i, t) for i, t in enumerate(base[:4])]  # exact copies
    for i, t in enumerate(base[:6]):  # near copies: one word replaced
        w = t.split()
        w[40] = "zzzz"
        rows.append((200 + i, " ".join(w)))
    rows += [(300 + i, sentence(rng, 30) + "\n" + base[7] + " \t" + sentence(rng, 30) + "\nAll rights reserved.") for i in range(4)]  # a shared passage
    rows += [(400, None), (401, ""), (402, " \n\t\n "), (403, "one two"), (404, "ünï çödé " * 60), (405, "x" * 5000), (406, "ab " * 3000), (407, sentence(rng, 20_000)), (408, "a\x1cb \x00 c"), (409, "x" * 5000)]
    rows += [(None, base[9]), (None, None), (5, base[5]), (5, base[5])]  # null ids, repeated rows
    lines = [sentence(rng, 9) for _ in range(5)]
    rows += [(500, "\n".join(lines)), (501, "\n".join([lines[0], "", lines[1] + " more", lines[2].split(" ", 1)[1], "no", ""])), (502, "no\n" + lines[3].replace(lines[3].split()[4], "other"))]
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "src0", len(t or ""), "k", "h", 1, "l", "a", "u") for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def order(i):
    return -(2**63) if i is None else i


def norm(rows):
    return sorted(rows, key=str)


# -- op1


def test_packing(docs, rows, empty):
    got = op1.pack(docs).collect()
    tok = op1.word_ids(op1.tokenizer_path()).whole
    want = Counter()
    for i, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        for p, a in enumerate(range(0, len(ids), 2048)):
            want[i, p, a, len(ids[a : a + 2048]), zlib.crc32(np.array(ids[a : a + 2048], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for p in places.values():
        at = 0
        for a, n in sorted(p):
            assert a == at
            at += n
        assert at <= 2048
    assert len(places) <= -(-sum(r.length for r in got) // 2048) + 1
    assert op1.pack(empty).count() == 0


def test_packing_tree(spark, monkeypatch):
    """Many small groups over several rounds pack about as well as one group does."""
    monkeypatch.setattr(op1, "GROUP_BINS", 6)
    rng = random.Random(8)
    sizes = [rng.choice([3, 40, 300, 700, 900, 1100, 1500]) for _ in range(900)]
    docs = spark.createDataFrame([(i, "go " * (n - 1)) for i, n in enumerate(sizes)], "doc_id long, text string").repartition(24)
    got = op1.pack(docs).collect()
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for p in places.values():
        assert [a for a, _ in sorted(p)] == [sum(n for _, n in sorted(p)[:i]) for i in range(len(p))]
        assert sum(n for _, n in p) <= 2048
    assert sorted(r.length for r in got) == sorted(sizes)
    assert len(places) <= 1.02 * len(set(op1.best_fit(np.array(sizes))[0].tolist()))


def test_packing_in_parts(docs, monkeypatch):
    whole = {(r.doc_id, r.piece, r.ids_crc32) for r in op1.pack(docs).collect()}
    monkeypatch.setattr(op1, "LOCAL_PIECES", 3)
    got = op1.pack(docs).collect()
    assert {(r.doc_id, r.piece, r.ids_crc32) for r in got} == whole
    starts = Counter((r.sequence_id, r.offset) for r in got)
    assert max(starts.values()) == 1


def test_word_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(op1, "CACHE_BYTES", 5_000)
    ids = op1.WordIds(op1.tokenizer_path())
    ids.room = 5_000
    rng = random.Random(1)
    for _ in range(300):
        text = sentence(rng, 20) + " it's a-b,c 12 " + "y" * 500 + " ünï«çödé» <|x|>"
        assert ids.encode(text) == ids.encode_whole(text)
        assert all(sum(len(k) + len(v) + op1.ENTRY_BYTES for k, v in part.items()) <= 6_000 for part in (ids, ids.old))


# -- op2, op4: SQL


def duck(**tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name + "_df", df.toPandas())
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM {name}_df")
    return con


def test_licenses(docs, empty, spark):
    rng = random.Random(1)
    mit = dict(op2.TEMPLATES)["MIT-permission"].split()
    texts = [(1, sentence(rng, 200) + " Released under the MIT License. " + sentence(rng, 300)), (2, " ".join(mit)), (3, " ".join(mit[:-2])), (4, " ".join(mit[:9])), (5, None), (6, "ALL RIGHTS RESERVED"), (7, sentence(rng, 40) + "\n" + " ".join(w for i, w in enumerate(mit) if i != 1) + "\n" + sentence(rng, 40))]
    small = spark.createDataFrame(texts, "doc_id long, text string")
    got = {(r.k, r.license, r.found, r.of, r.window) for r in op2.scan(small).collect()}
    want = set(duck(documents=small).sql('SELECT doc_id, license, found, of, "window" FROM (' + op2.ORACLE + ")").fetchall())
    assert got == want
    assert {i for i, *_ in got} == {1, 2, 3, 6, 7}
    assert op2.scan(empty).count() == 0
    assert {r.license for r in op2.scan(docs).collect()} == {"reserved"}


def test_many_templates_are_joined(spark, docs, monkeypatch):
    """Beyond the bounds for literals and broadcast the same rows come from joins."""
    rng = random.Random(2)
    templates = [(f"t{k}", sentence(rng, rng.randrange(3, 40))) for k in range(25)] + op2.TEMPLATES
    texts = [(i, sentence(rng, 30) + " " + " ".join(t.split()[: max(1, len(t.split()) * (7 + i % 4) // 10)]) + " " + sentence(rng, 30)) for i, (_, t) in enumerate(templates)]
    some = spark.createDataFrame([*texts, (None, None), (1, "")], "doc_id long, text string").repartition(2)
    plain = norm(tuple(r) for r in op2.scan(some, templates).collect())
    monkeypatch.setattr(op2, "LITERALS", 3)
    monkeypatch.setattr(op2, "BROADCAST_BANDS", 3)
    assert norm(tuple(r) for r in op2.scan(some, templates).collect()) == plain
    assert len(plain) > 10


def test_urls(spark):
    urls = ["https://www.example.com/en/a?x#y", "http://Example.COM/en/", "http://b.example.com/de/1", "ftp://spam-farm.org/x", "http://x.net/es/a", "http://x.net/essay", "nothing", "", None, "http://", "http://net/fr/", "http://cheap-pills.www.example.com/en/", "http://a.org/?q=spam-farm."]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)] + [(0, urls[0], "h")], "page_id long, url string, host string")

    def judge(u):
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
        fit = [r for r in op4.HOST_RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
        best = max(fit, key=lambda r: (len(r[0]), len(r[1])), default=None)
        hit = any(re.search(p, u.lower()) for _, _, p in op4.PATTERN_RULES) if m else False
        return host, path, best and best[0] + best[1], best[2] if best else "block" if hit else "allow"

    got = op4.filter_urls(pages, "page_id", "url").collect()
    assert norm((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got) == norm((i, *judge(u)) for i, u in [*enumerate(urls), (0, urls[0])])
    assert op4.filter_urls(pages.limit(0), "page_id", "url").count() == 0


def test_joined_spellings(spark):
    urls = ["http://spamfarm.net/x", "https://www.casinowin.org/", "http://freebets.example.net/a", "http://a-cheappills-b.org", "http://ADULTX.org/", "http://ads-track.org/", "http://b.adstrack-x.org/?a", "http://spamfarms.net/x", "http://xspamfarm.net/"]
    want = ["spam-farm", "casino-win", "free-bets", "cheap-pills", "adult-x", "ads-track", "ads-track", None, None]
    got = op4.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), "page_id", "url").collect()
    assert [(r.pattern, r.verdict) for r in sorted(got)] == [(w, "block" if w else "allow") for w in want]


def test_generated_urls_against_every_rule(spark, monkeypatch):
    """Both spellings of every rule, and near misses, with the rules broadcast and shuffled: the same as running all regular expressions on all URLs."""
    rng, urls = random.Random(5), []
    for name, (two, _), _ in op4.PATTERN_RULES:
        a, b = two
        urls += [f"http://{rng.choice(['', 'www.', 'x-', 'm.shop.'])}{a}{rng.choice(['-', ''])}{b}{rng.choice(['.org/', '-1.net/y', '.EXAMPLE.org'])}", f"http://a.org/{a}-{b}.html", f"http://{a}s-{b}.org/", f"http://{a}.{b}.org/?q={a}{b}."]
        assert name == f"{a}-{b}"
    want = [min((n for n, _, r in op4.PATTERN_RULES if re.search(r, u.lower())), default=None) for u in urls]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    assert len(op4.PATTERN_RULES) == 240
    assert sum(w is not None for w in want) >= 240
    for most in (op4.BROADCAST_RULES, 10):
        monkeypatch.setattr(op4, "BROADCAST_RULES", most)
        assert [r.pattern for r in sorted(op4.filter_urls(pages, "page_id", "url").collect())] == want


def test_rule_tokens_are_required():
    assert op4.required_tokens(r"://([^/?#]*[.-])?spam-?farm[.-]") == [{"spamfarm"}, {"spam", "farm"}] * 2
    assert op4.required_tokens(r"/(ab|c)/x[0-9]/y+/z") == [{"ab"}, {"c"}]
    op4.check_patterns(op4.PATTERN_RULES)
    for spellings, regex in [([["spam", "farm"]], r"/spam-?farm/"), ([["spam"]], r"/spam"), ([["spam"]], r"/.*spam/"), ([[]], r"/spam/"), ([["spam"]], r"(?i:/spam/)")]:
        with pytest.raises(ValueError):
            op4.check_patterns([("rule", spellings, regex)])


# -- op3


def removed_bytes(rows):
    """(id, bytes, removed, spans, digest of the rest) of (id, text) rows, by brute force."""
    raw = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[a : a + 200] for _, b in raw for a in range(len(b) - 199))
    out = []
    for i, b in raw:
        gone = np.zeros(len(b), bool)
        for a in range(len(b) - 199):
            if seen[b[a : a + 200]] > 1:
                gone[a : a + 200] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum())
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return norm(out)


def op3_rows(df):
    return norm((r.k, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in op3.dedup(df).withColumn("k", real_id()).collect())


def test_suffix_dedup(docs, rows, empty):
    assert op3_rows(docs) == removed_bytes(rows)
    assert op3.dedup(empty).count() == 0


def contexts(rng, n):
    """Texts around a passage of 330 bytes: at random, and with few and many letters in common next to it."""
    passage, words = sentence(rng, 60)[:330], sentence(rng, 40).split()
    for i in range(n):
        left, right = sentence(rng, 30) + " ", " " + sentence(rng, 30)
        cut = rng.randrange(0, 130)
        middle = passage if i % 3 else passage[cut : cut + 190]
        if i % 5 == 0:
            left += " ".join(words[rng.randrange(40) :]) + " "
        if i % 7 == 0:
            right = " " + " ".join(words[: rng.randrange(40)]) + right
        yield i, left + middle + right


@pytest.mark.parametrize("limit", [1, 3, 40])
def test_wide_groups_are_narrowed(docs, rows, spark, monkeypatch, limit):
    monkeypatch.setattr(op3, "GROUP_SEGMENTS", limit)
    some = [*rows, *((1000 + i, t) for i, t in contexts(random.Random(3), 150))]
    assert op3_rows(spark.createDataFrame(some, "doc_id long, text string").repartition(3)) == removed_bytes(some)


def test_a_passage_in_thousands_of_contexts(spark):
    some = list(contexts(random.Random(4), 2_400))
    assert op3_rows(spark.createDataFrame(some, "doc_id long, text string").repartition(4)) == removed_bytes(some)


def test_long_documents_go_in_pieces(spark):
    rng = random.Random(6)
    shared = sentence(rng, 200)
    long = [sentence(rng, 9_000), shared, sentence(rng, 9_000), shared[:300], sentence(rng, 3_000)]
    some = [(1, " ".join(long)), (2, shared), (3, sentence(rng, 50) + long[2][-2_000:] + " " + shared[:300])]
    part = op3.SLICE_BYTES
    try:
        op3.SLICE_BYTES = 10_000
        data = "".join(t for _, t in some[:1]).encode()
        batch = op3.pa.RecordBatch.from_pydict({"k": [1], "h": [2], "text": [data.decode()]})
        pieces = [r for b in op3._anchors(iter([batch])) for r in b.to_pylist()]
    finally:
        op3.SLICE_BYTES = part
    windows = sorted(w for r in pieces for w in range(r["lo"], r["lo"] + r["n"]))
    assert windows == list(range(len(data) - 199))
    assert op3_rows(spark.createDataFrame(some, "doc_id long, text string")) == removed_bytes(some)


def thue_morse(n, letters="ab"):
    """Two different words of 2 ** n letters that any polynomial modulo 2 ** 64 takes for one (n > 10)."""
    s = "0"
    for _ in range(n):
        s += s.translate(str.maketrans("01", "10"))
    return [s.translate(str.maketrans("01", p)) for p in (letters, letters[::-1])]


def test_words_that_cancel_out(spark):
    rng = random.Random(12)
    x, y = thue_morse(12)
    head, tail = sentence(rng, 19), sentence(rng, 19)
    some = [(1, x), (2, y), (3, f"{head} {x} {tail}"), (4, f"{head} {y} {tail}"), (5, "\n".join([x, y, x])), (6, " ".join(x)), (7, " ".join(y))]
    df = spark.createDataFrame(some, "doc_id long, text string").repartition(2)
    assert op3_rows(df) == removed_bytes(some)
    assert op8_rows(df) == removed_words(some)
    lines = {r.doc_id: r.n_dup_lines for r in op5.judge(df, op5.Crf()).collect()}
    assert lines == {**dict.fromkeys(range(1, 8), 0), 5: 1}
    found = {r.doc_id: r.class_id for r in op6.near_duplicates(df).collect()}
    assert found[1] != found[2]


def test_expansion_finds_shared_prefixes():
    rng = np.random.default_rng(1)
    for t in range(60):
        s = np.frombuffer(b"".join(bytes(rng.integers(97, 99 + t % 3, rng.integers(1, 50))) + b"\xff" for _ in range(rng.integers(1, 6))), np.uint8)
        d, b = int(rng.integers(1, 14)), s.tobytes()
        c = Counter(b[i : i + d] for i in range(len(b) - d + 1))
        got = op3.shares_prefix(s, d)
        assert all(got[i] == (c[b[i : i + d]] > 1) for i in range(len(b) - d + 1) if b"\xff" not in b[i : i + d])


# -- op5


def test_quality_rules(docs, rows, spark, empty):
    labels = spark.createDataFrame([(0, 1), (1, 1), (405, 0), (406, 0), (None, 1), (2, None)], "doc_id long, quality int")
    got = op5.judge(docs, op5.fit(docs, labels)).collect()
    want = []
    for i, t in rows:
        w = WORD.findall(t or "")
        grams = [tuple(w[a : a + 8]) for a in range(len(w) - 7)]
        c, marked = Counter(grams), set()
        for a, g in enumerate(grams):
            if c[g] > 1:
                marked.update(range(a, a + 8))
        seen, dup = set(), 0
        for line in (t or "").split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        want.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(marked), len(w) < 20 or 100 * len(marked) > 30 * len(w)))
    assert norm(tuple(r)[:7] for r in got) == norm(want)
    assert all(not (r.base_failed and r.kept) for r in got)
    assert op5.judge(empty, op5.Crf()).count() == 0
    assert op5.fit(docs, labels.limit(0)).weights is None


def test_viterbi():
    rng = np.random.default_rng(0)
    for _ in range(30):
        lengths = rng.integers(0, 6, rng.integers(1, 5))
        scores, moves, at = rng.normal(size=(lengths.sum(), 2)), rng.normal(size=(2, 2)), 0
        got = op5.viterbi(scores, lengths, moves)
        for n in lengths.tolist():
            best = max(itertools.product((0, 1), repeat=n), key=lambda q, n=n, at=at: sum(scores[at + i, q[i]] for i in range(n)) + sum(moves[q[i], q[i + 1]] for i in range(n - 1)))
            assert tuple(got[at : at + n]) == best
            at += n


def test_boilerplate_is_found():
    rng = random.Random(2)
    sequences = []
    for k in range(60):
        text = "\n".join(sentence(rng, 12) + "." if k % 2 else " | ".join(["ABC$$", "x*"] * 3) for _ in range(4)).encode()
        data, offs = np.frombuffer(text, np.uint8), np.array([0, len(text)])
        sequences.append((op5.Lines(data, offs).features(data), k % 2))
    crf = op5.train(sequences)
    assert all((crf.content(f, np.array([len(f)])) == bool(y)).all() for f, y in sequences)


def test_boilerplate_inside_good_documents():
    """Lines are told apart within a document: boilerplate planted in good held-out documents is found, and what stands around it stays."""
    con = duckdb.connect()
    base = "/root/testdata/sf0.01"
    rows = con.sql(f"SELECT d.doc_id, l.quality, d.text FROM '{base}/documents.parquet' d JOIN '{base}/labels.parquet' l USING (doc_id) WHERE text IS NOT NULL ORDER BY doc_id").fetchall()
    out = [zlib.crc32(str(i).encode()) % 3 == 1 for i, *_ in rows]

    def lines(text):
        data = np.frombuffer(text.encode(), np.uint8)
        found = op5.Lines(data, np.array([0, len(data)]))
        return found.features(data)

    crf = op5.train([(f[a : a + 32], q) for (_, q, t), held in zip(rows, out, strict=True) if not held for f in [lines(t)] for a in range(0, len(f), 32)])
    rng = random.Random(3)
    junk = [x for (_, q, t), held in zip(rows, out, strict=True) if held and not q for x in t.split("\n") if len(x.split()) >= 8 and sum(c in "#*$%&|<>!" for c in x) > 0.5 * len(x.split())]
    right = wrong = missed = 0
    for (_, q, t), held in zip(rows, out, strict=True):
        if held and q:
            own = [(x, False) for x in t.split("\n") if x.split()]
            for _ in range(2):
                own.insert(rng.randrange(len(own) + 1), (" ".join(rng.choice(junk).split()[: rng.randrange(8, 60)]), True))
            content = crf.content(lines("\n".join(x for x, _ in own)), np.array([len(own)]))
            right += sum(bad and not c for (_, bad), c in zip(own, content, strict=True))
            wrong += sum(not bad and not c for (_, bad), c in zip(own, content, strict=True))
            missed += sum(bad and bool(c) for (_, bad), c in zip(own, content, strict=True))
    assert 2 * right / (2 * right + wrong + missed) >= 0.9


# -- op6


def probability_jaccard(x, y):
    return sum(1 / sum(max(x[j] / x[i], y[j] / y[i]) for j in x.keys() | y.keys()) for i in x.keys() & y.keys())


def test_near_duplicates(docs, rows, empty):
    small = [(i, t) for i, t in rows if i != 407]
    sets = [Counter(tuple(w[a : a + 5]) for a in range(len(w) - 4)) for w in (WORD.findall(t or "") for _, t in small)]
    parent = list(range(len(small)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in itertools.combinations(range(len(small)), 2):
        equal = small[a][1] == small[b][1] and WORD.search(small[a][1] or "")
        if equal or sets[a] and sets[b] and probability_jaccard(sets[a], sets[b]) >= 0.8:
            parent[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(small):
        least[find(a)] = min(least.get(find(a), order(i)), order(i))
    want = norm((i, None if least[find(a)] == order(None) else least[find(a)]) for a, (i, _) in enumerate(small))
    some = docs.where("doc_id IS NULL OR doc_id != 407")
    assert norm(tuple(r) for r in op6.near_duplicates(some).collect()) == want
    kept = op6.keep_one(some)
    assert kept.columns == docs.columns
    words = [a for a, (_, t) in enumerate(small) if WORD.search(t or "")]
    assert kept.where("text rlike '[^\\\\x20\\\\x09-\\\\x0D]'").count() == len({find(a) for a in words})
    assert op6.near_duplicates(empty).count() == 0
    assert op6.keep_one(empty).count() == 0


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(3)
    ids = rng.integers(0, 2**62, 400).astype(np.uint64)
    x, y = {int(i): int(rng.integers(1, 4)) for i in ids[:320]}, {int(i): int(rng.integers(1, 4)) for i in ids[80:]}
    y |= {i: x[i] for i in list(x)[80:] if i in y}
    arrays = [(np.full(len(d), r), np.array(sorted(d), np.uint64), np.array([d[k] for k in sorted(d)])) for r, d in enumerate((x, y))]
    sig = op6.signatures(*(np.concatenate(c) for c in zip(*arrays, strict=True)), 2)
    exact = op6.similarity(arrays[0][1], arrays[0][2], arrays[1][1], arrays[1][2])
    assert abs(exact - probability_jaccard(Counter(x), Counter(y))) < 1e-9
    assert abs((sig[0] == sig[1]).mean() - exact) < 0.15


def test_short_pairs_are_met_across_classes(spark):
    rng, texts = random.Random(11), []
    for common, new in [(4, 1), (9, 2), (13, 3), (17, 4), (21, 5)]:  # J_P from 0.8 to 0.82, and just below
        for _ in range(60):
            w = sentence(rng, common + 4).split()
            texts += [w, w + sentence(rng, new).split(), sentence(rng, new + 1).split() + w]
    sets = [Counter(tuple(w[a : a + 5]) for a in range(len(w) - 4)) for w in texts]
    want = {(a, b) for i in range(0, len(sets), 3) for a, b in itertools.combinations(range(i, i + 3), 2) if probability_jaccard(sets[a], sets[b]) >= 0.8}
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "id long, text string").repartition(2)
    stored = op6.settle(docs.mapInArrow(op6._sets, "id long, shingles binary, weights binary"))
    rare = op6.rare_shingles(stored).withColumn("root", op6.F.col("id"))
    assert {tuple(r) for r in op6.verified(op6.across(rare, op6.sketches(stored)), stored).collect()} == want
    assert len(want) == 300


def test_all_similar_documents_share_a_class(spark):
    """Of the given documents: every pair with a probability Jaccard similarity of 0.8 or more, found by comparing all pairs that share a shingle."""
    base = "/root/testdata/sf0.001/documents.parquet"
    rows = duckdb.connect().sql(f"SELECT doc_id, text FROM '{base}' WHERE text IS NOT NULL").fetchall()
    sets = {i: Counter(tuple(w[a : a + 5]) for a in range(len(w) - 4)) for i, t in rows for w in [WORD.findall(t)]}
    holders = {}
    for i, s in sets.items():
        for g in s:
            holders.setdefault(g, []).append(i)
    pairs = {p for h in holders.values() for p in itertools.combinations(sorted(h), 2)}
    similar = [(a, b) for a, b in pairs if sum((sets[a] & sets[b]).values()) * 5 >= 2 * max(sum(sets[a].values()), sum(sets[b].values())) and probability_jaccard(sets[a], sets[b]) >= 0.8]
    found = {r.doc_id: r.class_id for r in op6.near_duplicates(spark.read.parquet(base)).collect()}
    assert similar
    assert np.mean([found[a] == found[b] for a, b in similar]) >= 0.99


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert got == {**dict.fromkeys(range(41), 0), 90: 90, 95: 90, 100: 90}


# -- op7


def test_decontamination(docs, spark, empty):
    rng = random.Random(9)
    items = [(i, sentence(rng, 30)) for i in range(5)] + [(9, None), (8, "")]
    w = items[1][1].split()
    w[7], w[15] = "changed", "too"
    found = [(1000, sentence(rng, 50) + " " + items[0][1] + ". " + sentence(rng, 50)), (1001, sentence(rng, 10) + " " + " ".join(w)), (1002, sentence(rng, 60)), (1003, items[2][1].upper()), (1000, items[0][1])]
    small = docs.select("doc_id", "text").unionByName(spark.createDataFrame(found, "doc_id long, text string"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = Counter((r.doc_id, r.item_id) for r in op7.find_leaks(small, bench).collect())
    assert got == Counter({(1000, 0): 2, (1001, 1): 1, (1003, 2): 1})
    assert op7.drop_leaks(small, bench).count() == small.count() - 4
    assert op7.find_leaks(empty, bench).count() == 0
    assert op7.find_leaks(docs, bench.limit(0)).count() == 0


def test_items_of_frequent_words_are_found(spark):
    rng = random.Random(4)
    common = sentence(rng, 14).split()
    item = rng.choices(common, k=18)
    texts = [rng.choices(common, k=400) for _ in range(150)] + [sentence(rng, 40).split() for _ in range(50)]
    for at in range(18):  # an edited copy among rare words, and one with all but a few neighbours replaced
        edited = [w if k != at else "changed" for k, w in enumerate(item)]
        texts += [sentence(rng, 30).split() + edited + sentence(rng, 30).split(), [w if k % 5 != at % 5 else f"x{k}" for k, w in enumerate(item)]]
    codes = {w: k for k, w in enumerate({w for t in [*texts, item] for w in t})}
    coded = np.array([codes[w] for w in item])
    want = {i: s / 36 for i, t in enumerate(texts) if (s := op7.align(coded, np.array([codes[w] for w in t]))) >= 18}
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(item)), (2, sentence(rng, 20))], "item_id long, text string")
    got = op7.find_leaks(docs, bench).where("item_id = 1").collect()
    assert {r.doc_id: r.score for r in got} == want
    assert want.keys() >= set(range(200, 236))


def test_copies_with_every_third_word_replaced_are_found(spark):
    """All documents that an alignment of every document with every item finds are found, with words replaced, dropped and put in at many places."""
    rng = random.Random(21)
    items = [(i, sentence(rng, 27).split()) for i in range(8)]
    texts = [sentence(rng, 50).split() for _ in range(30)]
    for i, w in items:
        for at in range(3):
            texts.append(sentence(rng, 20).split() + [x if k % 3 != at else f"new{k}" for k, x in enumerate(w)] + sentence(rng, 20).split())
        for share in (0.1, 0.2, 0.25, 0.3, 0.34):
            out = []
            for k, x in enumerate(w):
                turn = rng.random()
                if turn >= share:
                    out.append(x)
                elif turn < share / 3:
                    out.append(f"other{k}")
                elif turn < share * 2 / 3:
                    out += [x, f"more{k}"]
            texts.append(sentence(rng, 20).split() + out + sentence(rng, 20).split())
    codes = {w: k for k, w in enumerate({w for t in [*texts, *(w for _, w in items)] for w in t})}
    coded = [np.array([codes[w] for w in t]) for t in texts]
    want = {(d, i): s for i, w in items for d, t in enumerate(coded) if (s := op7.align(np.array([codes[x] for x in w]), t) / (2 * len(w))) >= 0.5}
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in op7.find_leaks(docs, spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")).collect()}
    assert got == want
    assert len(want) > 45


def test_alignment_is_the_best_local_one():
    """Against the plain table of scores."""
    rng = random.Random(2)
    for _ in range(200):
        a, b = [[rng.randrange(4) for _ in range(rng.randrange(1, 12))] for _ in range(2)]
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
            table[i][j] = max(0, table[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), table[i - 1][j] - 1, table[i][j - 1] - 1)
        assert op7.align(np.array(a), np.array(b)) == max(map(max, table))


def test_clashing_columns_keep_their_values(docs, spark):
    """Stages give back the caller's columns, whatever their names."""
    names = ["k", "h", "__k", "__h", "__c", "__near", "__removed", "__lines", "c", "near", "removed", "lines", "_k"]
    wide = docs.drop("k", "h", "__k").select("*", *[op6.F.concat(op6.F.lit(n), op6.F.coalesce(op6.F.col("doc_id").cast("string"), op6.F.lit("-"))).alias(n) for n in names])
    bench = spark.createDataFrame([(1, "nothing of this is in there at all")], "item_id long, text string")
    labels = spark.createDataFrame([(0, 1), (1, 1)], "doc_id long, quality int")
    for out in (op6.keep_one(wide), op10.dedup(wide), op7.drop_leaks(wide, bench), op9.filter_documents(wide, labels)):
        assert out.columns == wide.columns
        rows = out.collect()
        assert rows
        assert all(r[n] == f"{n}{'-' if r.doc_id is None else r.doc_id}" for r in rows for n in names)


def test_alignment():
    a, b = np.array([1, 2, 3, 4]), np.array([9, 1, 2, 8, 3, 4, 9])
    assert op7.align(a, b) == 7  # four matches, one gap
    assert op7.align(a, np.array([5, 6])) == 0


# -- op8


def removed_words(rows):
    """(id, words, removed, digest of the rest) of (id, text) rows, by brute force."""
    seen, out = {}, []
    for i, t in sorted(rows, key=lambda r: order(r[0])):
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for a in range(len(w) - 19):
            place = (order(i), t, a)
            if seen.setdefault(tuple(w[a : a + 20]), place) != place:
                gone[a : a + 20] = [True] * 20
        out.append((i, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest()))
    return norm(out)


def op8_result(df):
    return norm((r.k, r.n_words, r.n_removed, hashlib.sha256(r.kept).hexdigest()) for r in df.withColumn("k", real_id()).collect())


def op8_rows(df, batches=op8.BATCHES):
    return op8_result(op8.dedup(df, batches=batches))


@pytest.mark.parametrize("batches", [1, 2, 6])
def test_substring_dedup(docs, rows, empty, batches):
    assert op8_rows(docs, batches) == removed_words(rows)
    if batches == 1:
        assert op8.dedup(empty).count() == 0


def test_hot_passages_of_words(spark, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", 20)
    some = list(contexts(random.Random(7), 300))
    assert op8_rows(spark.createDataFrame(some, "doc_id long, text string").repartition(3)) == removed_words(some)
    assert op3_rows(spark.createDataFrame(some[:150], "doc_id long, text string").repartition(3)) == removed_bytes(some[:150])


def test_an_index_is_opened_again(spark, rows, tmp_path):
    some = [(i, t) for i, t in rows if i is not None]
    df, path, spans = spark.createDataFrame(some, "doc_id long, text string"), f"file://{tmp_path}/index", None
    for low, high in [(-1, 3), (3, 9), (9, 150), (150, 210), (210, 402), (402, 999)]:
        index = op8.FingerprintIndex.open(spark, path)
        got = op8.repeats_in(op8.keyed(df.where(f"doc_id > {low} and doc_id <= {high}")), index, op8.keyed(df.where(f"doc_id <= {high}")))
        spans = got if spans is None else spans.unionByName(got)
        levels = [len(x) for x in index.levels]
        index.close()
    assert levels == [0, 1, 1]  # six runs: four compacted to one, and the last two
    assert len(list(tmp_path.glob("index/run_*"))) == 2
    assert op8_result(op8.without(op8.keyed(df), spans)) == removed_words(some)


# -- op9


def test_classifier(spark, docs, empty):
    base = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{base}/labels.parquet").collect()}
    out = op9.op9_quality_classifier(spark, base).collect()
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.9
    labels = spark.createDataFrame([(0, 1), (405, 0), (None, 1), (1, None), (0, 0)], "doc_id long, quality int")
    model = op9.fit(docs, labels)
    got = op9.score(docs, model).collect()
    assert len(got) == docs.count()
    assert all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in got if r.doc_id in (400, 401, 402)} == {0.0}
    assert op9.score(empty, op9.fit(empty, labels)).count() == 0
    assert op9.filter_documents(docs, labels).columns == docs.columns


# -- op10


def test_words_of_lines(spark):
    lines = ["a b", " a  b ", "a\tb\rc", "\x0b\x0ca\x0bb \x0c", "a\x1cb\x85c\u00a0d", "", " \t "]
    got = spark.createDataFrame([(x,) for x in lines], "line string").select(op10.words_of().alias("w")).collect()
    assert [r.w for r in got] == [WORD.findall(x) for x in lines]


def near(a, b):
    if len(a) < 5 or len(b) < 5:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def test_line_dedup(docs, rows, empty):
    own = {}
    for i, t in rows:
        for no, line in enumerate((t or "").split("\n")):
            if WORD.search(line):
                own.setdefault((order(i), t, no), (line, WORD.findall(line)))
    gone = {p for p, (line, w) in own.items() for q, (line2, w2) in own.items() if (q[0], q[2]) < (p[0], p[2]) and (line == line2 or near(w, w2))}
    want = norm((i, ",".join(str(no) for no in range(len((t or "").split("\n"))) if (order(i), t, no) in gone)) for i, t in rows)
    got = op10.line_report(docs).collect()
    assert norm((r.doc_id, r.removed) for r in got) == want
    after = op10.dedup(docs)
    assert after.columns == docs.columns
    left = {r.doc_id: r.text for r in after.collect()}
    by_id = dict(want)
    for i, t in rows:
        if i is not None and by_id[i]:
            text = "\n".join(x for no, x in enumerate(t.split("\n")) if str(no) not in by_id[i].split(","))
            assert left.get(i, "") == (text if WORD.search(text) else "")
    assert op10.line_report(empty).count() == 0
    assert op10.dedup(empty).count() == 0


# -- all


def test_pipeline_keeps_columns_and_packs(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "line_dedup", "near_dedup", "decontaminate", "pack"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    step = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.settle(stage(spark, step, SF))
        assert after.columns == docs.columns
        assert 0 < after.count() <= step.count()
        step = after
    assert {r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, step, SF).collect()} == {r.doc_id for r in step.collect()}


def test_pipeline_against_brute_force(spark):
    """The whole pipeline, stage by stage, as plain loops over all rows and pairs; only the classifier's fitted numbers are taken over."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect()]

    model = op9.fit(docs, labels)
    raw = [(t or "").encode() for _, t in rows]
    scores = model.score(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    rows = [r for r, s in zip(rows, scores, strict=True) if s >= 0.5]

    seen, own, after = {}, [], []
    for i, t in sorted(rows):
        for no, line in enumerate(t.split("\n")):
            if WORD.search(line):
                own.append(((i, no), line, WORD.findall(line)))
    by_size = {}
    gone = set()
    for place, line, w in own:  # in order: only earlier lines have been met
        if line in seen or any(near(w, x) for n in (len(w) - 1, len(w), len(w) + 1) for x in by_size.get(n, ())):
            gone.add(place)
        if line not in seen:
            seen[line] = place
            by_size.setdefault(len(w), []).append(w)
    for i, t in sorted(rows):
        text = "\n".join(x for no, x in enumerate(t.split("\n")) if (i, no) not in gone)
        if WORD.search(text):
            after.append((i, text))

    sets = {i: Counter(tuple(w[a : a + 5]) for a in range(len(w) - 4)) for i, t in after for w in [WORD.findall(t)]}
    root = {i: i for i, _ in after}

    def find(a):
        return a if root[a] == a else find(root[a])

    texts = dict(after)
    for a, b in itertools.combinations(sorted(sets), 2):
        if texts[a] == texts[b] or sets[a] and sets[b] and sum((sets[a] & sets[b]).values()) * 5 >= 2 * max(map(sum, (sets[a].values(), sets[b].values()))) and probability_jaccard(sets[a], sets[b]) >= 0.8:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    after = [(i, t) for i, t in after if find(i) == i]

    def plain(t):
        return ["".join(c.lower() if c.isascii() else c for c in w) for w in re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", t)]

    codes = {}
    coded = {k: np.array([codes.setdefault(w, len(codes)) for w in plain(t)]) for k, t in [*((("item", i), t) for i, t in items.items()), *after]}
    leaks = {i for i, _ in after for k in items for w in [coded["item", k]] if len(w) and 2 * np.isin(w, coded[i]).sum() >= len(w) and op7.align(w, coded[i]) >= len(w)}
    after = [(i, t) for i, t in after if i not in leaks]

    tok = op1.word_ids(op1.tokenizer_path()).whole
    want = Counter()
    for i, t in after:
        ids = tok.encode(t, add_special_tokens=False).ids + [0]
        for p, a in enumerate(range(0, len(ids), 2048)):
            want[i, p, a, len(ids[a : a + 2048]), zlib.crc32(np.array(ids[a : a + 2048], "<u4").tobytes())] += 1
    got = corpus_pipeline.run(spark, SF).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    assert 0 < len(after) < len(raw)


def test_pipeline_takes_odd_tables(spark, docs, empty, tmp_path):
    """No rows; null ids and texts, repeated rows and clashing columns; no benchmark and no labels."""
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    for some in (empty, docs):
        step = some
        for _, stage in corpus_pipeline.STAGES[:-1]:
            step = corpus_pipeline.settle(stage(spark, step, str(tmp_path)))
            assert step.columns == docs.columns
        got = corpus_pipeline.STAGES[-1][1](spark, step, str(tmp_path)).collect()
        assert {r.doc_id for r in got} == {r.doc_id for r in step.collect()}
    assert None in {r.doc_id for r in got}
    assert sum(r.doc_id == 5 for r in got) <= 1  # repeated rows are one document
    some = docs.limit(0)
    some.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(name, spark):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(ORACLE_SQL[name])
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert norm(tuple(r[c] for c in columns) for r in got.collect()) == norm(tuple(r[i] for i in at) for r in want.fetchall())
