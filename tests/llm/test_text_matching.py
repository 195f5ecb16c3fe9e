"""Url rules, decontamination, secrets and personal data, each against a plain model and on odd rows."""

import hashlib
import math
import random
import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracemill.llm import decontaminate as D
from tracemill.llm import pii, secrets
from tracemill.llm import url_filter as U
from tracemill.llm.common import raw_text
from tracemill.llm.queries import QUERIES, URL_RULES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
URLS = [
    None, "", "no scheme", "http://Example.COM/en/1", "https://www.example.com/en/", "http://a.www.example.com/en/x?y", "http://example.com/en", "http://example.com", "http://example.com?x/en/",
    "http://notexample.com/en/", "https://x.net/es/1", "https://x.net/fr/#a", "https://net/es/", "ftp://x.org/fr/", "http://example.com:80/en/1", "://com/", "a://b://c.com/", "http://com/a/en/", "http://x.NET/es/\n/b",
]


def url_model(url):
    rest = url.partition("://")[2] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = host.translate(LOWER)
    hits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(hits, key=lambda r: (r.host.count("."), len(r.path)), default=None)
    return host, path, best and best.text, best.verdict if best else "allow"


def test_urls(spark):
    df = spark.createDataFrame([(i, u, "old", "old") for i, u in enumerate(URLS)], "page_id long, url string, verdict string, rule string")
    for limit in (U.MAX_TRIE_BYTES, 0):
        got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in U.filter_urls(df, URL_RULES, max_trie_bytes=limit).collect()}
        assert got == {i: url_model(u) for i, u in enumerate(URLS)}
    assert U.filter_urls(df.limit(0), URL_RULES).collect() == []
    assert {r["verdict"] for r in U.filter_urls(df, [], default="block").collect()} == {"block"}


def test_url_precedence():
    trie = U.UrlTrie([U.Rule("allow", "a.b", "/x/y"), U.Rule("block", "a.b", "/x/"), U.Rule("block", "b", ""), U.Rule("allow", "", "/z"), U.Rule("allow", "c", "/"), U.Rule("block", "c", "/")])
    assert trie.match("q.a.b", "/x/yz").path == "/x/y" and trie.match("a.b", "/x/q").path == "/x/"
    assert trie.match("b", "").host == "b" and trie.match("n", "/zz").host == "" and trie.match("n", "/y") is None
    assert trie.match("c", "/").verdict == "block"


ITEMS = [(1, "The quick brown fox jumps over the lazy dog again today"), (2, "short ITEM here"), (3, None), (4, " .,! "), (5, "short item here"), (None, "only marked words"), (12, "é1 ü2")]
DOCS = [
    (1, "x the QUICK, brown-fox jumps over\nthe lazy dog again! y"), (2, "a short item here and only marked words"), (3, None), (4, ""), (5, "clean words"), (6, "é1 ü2 É1 Ü2"), (None, "short item here"),
    (7, "short item"), (8, "z " * 3000 + "quick brown fox jumps over the lazy dog again today"), (1, "x the QUICK, brown-fox jumps over\nthe lazy dog again! y"),
]


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))


def bench_model(text, items, n=10):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        iw = words(t)
        m = min(n, len(iw))
        windows = {tuple(iw[i : i + m]) for i in range(len(iw) - m + 1)} if iw else set()
        for i in range(len(w) - m + 1):
            if tuple(w[i : i + m]) in windows:
                hit |= set(range(i, i + m))
                if item is not None:
                    found.add(str(item))
    return len(w), sorted(hit), sorted(found)


@pytest.mark.parametrize("block", [1, D.BLOCK_BYTES])
def test_decontamination(spark, block):
    docs = spark.createDataFrame([(i, t, "s") for i, t in DOCS], "doc_id long, text string, items string").coalesce(2)
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = sorted(((r["doc_id"] or 0, r["n_words"], r["hit_words"], r["items"]) for r in D.match_benchmark(docs, bench, block_bytes=block).collect()), key=str)
    assert got == sorted(((i or 0, *bench_model(t, ITEMS)) for i, t in DOCS), key=str)
    kept = D.decontaminate(docs, bench)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, t in DOCS if not bench_model(t, ITEMS)[1]}
    cut = {r["doc_id"]: r["text"] for r in D.decontaminate(docs, bench, action="spans").collect()}
    assert cut[2] == "a  and " and cut[5] == "clean words" and cut[3] is None and cut[1] == "x  y".replace("  ", " ! ") and len(cut) == 9
    assert D.match_benchmark(docs, bench.limit(0)).where(F.size("hit_words") > 0).isEmpty()
    assert D.match_benchmark(docs.limit(0), bench).collect() == []


def test_window_sets_are_small():
    rng = random.Random(3)
    items = [(i, " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(100))) for i in range(400)]
    size = sum(len(t) for _, t in items)
    assert D.WindowSet(items, 10).nbytes() < 9 * size + (1 << 17)


def test_windows_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(D, "window_hashes", lambda words, m: np.zeros(max(0, len(words) - m + 1), np.uint64))
    data, offs = raw_text(pa.array(["x a b y", "c d", "b a", "a b c d a b"]))
    _, _, rows, hit, items = D.scan_chunk(data, offs, D.WindowSet([(1, "a b"), (2, "c d"), (3, "a b"), (None, "q r")], 2))
    assert hit.tolist() == [False, True, True, False] + [True] * 2 + [False] * 2 + [True] * 6 and items == {0: {1, 3}, 1: {2}, 3: {1, 2, 3}}


SECRETS = [
    "token = 'abcdef'", "PassWord:abc", "api_key=\"Zz+/_.=-9\"", "apikey:12345 token=token=abcdefgh", "AKIA" + "A1" * 8, "AKIAAKIA" + "B" * 12, "AKIASHORT", "é\U0001F600 " + "0f" * 12 + " x", "0f" * 11 + "0",
    "", None, "secret" + " " * 500 + "=" + " " * 9 + "zzzzzz", "a" * 20000, "ghp_" + "x" * 36, "-----BEGIN RSA PRIVATE KEY-----", "ſecret=abcdef Kpasswd=abcdef", "f" * 40 + " " + "f" * 30, "token token: 'abcdef",
]


def secret_model(t):
    t, out = t or "", []
    for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.ASCII):
        out += [(m.start(), 0, m.end())] if len(m[2]) >= 6 else []
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(out)


def digest(spans, names):
    return hashlib.sha256(",".join(f"{names[k]}:{s}:{e}" for s, k, e in spans).encode()).hexdigest()


def test_secrets(spark, tmp_path):
    docs = spark.createDataFrame([(i if i % 5 else None, t, "c") for i, t in enumerate(SECRETS)] + [(1, SECRETS[1], "c"), (1, SECRETS[0], "c")], "doc_id long, text string, kinds string")
    names = [r.kind for r in secrets.RULES]
    texts = {(r["doc_id"], r["text"]) for r in docs.collect()}
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["op9_secrets"](spark, str(tmp_path)).collect()
    want = sorted(digest(secret_model(r["text"]), names) for r in docs.collect())
    assert sorted(r["base_sha256"] for r in got) == want and len(texts) == 19
    assert any("github:0:40" in r["spans"] for r in got) and any("private_key:0:31" in r["spans"] for r in got)
    fixed = secrets.redact(docs)
    assert fixed.columns == docs.columns and fixed.count() == len(want)
    out = {r["text"] for r in fixed.collect()}
    assert "[ASSIGN]'" in out and "é\U0001F600 [HEX] x" in out and None in out and "[HEX] [HEX]" in out
    assert secrets.scan(docs.limit(0)).collect() == []


def test_trigram_queries():
    q = secrets.trigram_query
    assert q("[a-z]+") is True and q("ab") is True and q("abc") == "abc" and q("ABc+d") is True and q("ABCd+e") == "abc"
    assert q("abc|xyz") == ("or", ["abc", "xyz"]) and q("abc|x") is True and q("(abc)?de") is True
    assert secrets.trigrams(q("abcd[0-9]+efg")) == {"abc", "bcd", "efg"}
    for rule in secrets.RULES:
        for text in SECRETS:
            if text and re.search(rule.pattern, text):
                assert holds(q(rule.pattern), text.lower()), (rule.kind, text)


def holds(query, text):
    if query is True or isinstance(query, str):
        return query is True or query in text
    return (all if query[0] == "and" else any)(holds(x, text) for x in query[1])


PRIVATE = [
    "mail a.b@c.de, x", "a@b a@b. a@b.c.d@e.f", "x@y.com_z@w.org", "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 01.002.0003.255", "4111 1111 1111 1111", "4111-1111-1111-1112", "4111111111111111 5", "+1 (743) 555-3824", "+12 3", "+1234567890123456",
    "é\U0001F600 q@r.st", "", None, "a" * 30000, "1" * 30000, ("a." * 9000) + "@b" + ".c" * 9000, "+" * 5000, "1 " * 9000, "1.1.1.1" + ".1" * 9000, "x@" * 5000,
]


def private_model(t):
    t, out = t or "", []
    out += [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) < 256 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(x) for x in m[0] if x.isdigit()][::-1]
        if 16 <= len(d) <= 19 and sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(d)) % 10 == 0:
            out.append((2, *m.span()))
    out += [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out)


def test_redaction_leaves_no_part_of_a_secret(spark):
    body = "\n".join(["MIIE" + "aB3+/x" * 10] * 20 + ["Qk9="])
    begin, end = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
    texts = {
        f"a {begin}\n{body}\n{end} z": "a [PRIVATE_KEY] z",
        f"a {begin}\r\nProc-Type: 4,ENCRYPTED\r\nDEK-Info: AES-128-CBC,0F\r\n\r\n{body}\r\n{end} z": "a [PRIVATE_KEY] z",
        "a " + f"{begin}\n{body}\n{end}".replace("\n", "\\n") + " z": "a [PRIVATE_KEY] z",
        f"a {begin}\n{body}\n and more": "a [PRIVATE_KEY]\n and more",
        f"{begin} is a line - no key": "[PRIVATE_KEY] is a line - no key",
        f"{begin}\n{body}\n{end}\nmid\n{begin}\n{body}\n{end}": "[PRIVATE_KEY]\nmid\n[PRIVATE_KEY]",
        "k AKIA" + "Q" * 16 + "0123456789abcdef" * 2 + " z": "k [ACCESS] z",
    }
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r["text"] for r in secrets.redact(docs).orderBy("doc_id").collect()] == list(texts.values())


def test_personal_data(spark, tmp_path):
    quick = [t for t in PRIVATE if t is None or not t.startswith(("aaaa", "1111111111111111111", "x@x@"))] + ["a" * 900, "1" * 900, "x@" * 300]
    docs = spark.createDataFrame([(i if i % 4 else None, t, "c") for i, t in enumerate(quick)] + [(1, quick[1], "c")], "doc_id long, text string, h string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["op3_pii"](spark, str(tmp_path)).collect()
    want = [digest([(s, k, e) for k, s, e in private_model(r["text"])], pii.NAMES) for r in docs.collect()]
    assert sorted(r["base_sha256"] for r in got) == sorted(want)
    clean = {r["text"] for r in pii.sanitize(docs).collect()}
    assert "mail [EMAIL], x" in clean and "é\U0001F600 [EMAIL]" in clean and "[PHONE]" in clean and None in clean
    assert pii.find_personal(docs.limit(0)).collect() == []


def test_long_runs_do_not_stall(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(PRIVATE)], "doc_id long, text string")
    assert pii.find_personal(docs).count() == len(PRIVATE)


def term_model(rows, threshold, significance):
    """Disclosing terms by plain counting: for each row the places of terms."""
    texts = [t or "" for _, t in rows]
    n = len(texts)
    names = ["email", "ip", "card", "phone"]
    entities = [{names[k] + ":" + t[s:e].lower() for k, s, e in private_model(t)} for t in texts]
    words = [[(m[0].lower(), *m.span()) for m in re.finditer(r"[^\W\d_]{3,}", t)] for t in texts]
    vocabulary = [{w for w in re.split(r"[\W\d_]+", t.lower()) if len(w) > 2} for t in texts]
    df_e, df_t, both = Counter(x for e in entities for x in e), Counter(x for v in vocabulary for x in v), Counter()
    free = []
    for t, e, w in zip(texts, entities, words):
        spans = private_model(t)
        own = [(x, s, z) for x, s, z in w if not any(a <= s < b for _, a, b in spans)]
        free.append(own if e else [])
        both.update((x, y) for x in e for y in {o[0] for o in own})
    out = []
    for e, own in zip(entities, free):
        marks = []
        for w, s, z in own:
            for x in e:
                if df_e[x] == n:
                    continue
                share = math.log2(n * both[x, w] / (df_e[x] * df_t[w])) / math.log2(n / df_e[x])
                a, p = both[x, w] / df_t[w], df_e[x] / n
                bound = math.exp(-df_t[w] * (a * math.log(a / p) + ((1 - a) * math.log((1 - a) / (1 - p)) if a < 1 else 0)))
                if share >= threshold - 1e-9 and bound <= significance:
                    marks.append((s, 4, z))
                    break
        out.append(marks)
    return out


@pytest.mark.parametrize("threshold,significance", [(0.9, 0.01), (0.7, 0.05), (0.4, 1.0)])
def test_disclosing_terms_against_plain_counts(spark, threshold, significance):
    rng = random.Random(9)
    common = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}x" for i in range(80)]
    people = [(f"p{i}@mail.org", f"name{'abcdefghij'[i]}", f"+1 555 010 {i:04d}") for i in range(10)]
    rows = []
    for i in range(400):
        w = [rng.choice(common) for _ in range(rng.randint(0, 30))]
        if rng.random() < 0.25:
            mail, name, phone = rng.choice(people)
            w += [mail] + [name] * (rng.random() < 0.8) + [phone] * (rng.random() < 0.3) + ["rare" + "".join(rng.choice("abcdefgh") for _ in range(6))]
            rng.shuffle(w)
        rows.append((i if i % 7 else None, " ".join(w)))
    rows += [(1000, "Élan namea p0@mail.org"), (1000, "Élan namea p0@mail.org"), (1001, None), (1002, "hot@x.org " + " ".join(common))] + [(2000 + i, f"hot@x.org {rng.choice(common)} q{'abcdefgh'[i % 8]}zz") for i in range(150)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, words int").repartition(3)
    found = pii.find_personal(docs, threshold=threshold, significance=significance).collect()
    want = {(i or -1, t or ""): sorted(m) for (i, t), m in zip(rows, term_model(rows, threshold, significance))}
    text_of = {(r["doc_id"] or -1, r["h"]): r["text"] or "" for r in docs.withColumn("h", F.xxhash64(F.coalesce("text", F.lit("")))).collect()}
    assert len(found) == len(rows)
    for r in found:
        at = (r["id"] or -1, text_of[r["id"] or -1, r["h"]])
        assert sorted(tuple(m) for m in r["marks"] if m[1] == 4) == want[at], at
    assert any(want.values())


def test_disclosing_terms(spark):
    rows = [(i, f"note {i} Xavier writes to zed@a.org about {i} again. " + "Words between. " * 20 + "Signed: Xavier") for i in range(6)]
    rows += [(100 + i, f"note {i} about cats writes again to nobody{i} words between signed") for i in range(60)]
    rows += [(200 + i, "note copy Yvonne to yy@b.org about") for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["id"]: [tuple(m) for m in r["marks"]] for r in pii.find_personal(docs).collect()}
    text = rows[0][1]
    assert {text[m[0] : m[2]] for m in found[0] if m[1] == 4} == {"Xavier"} and sum(m[1] == 4 for m in found[0]) == 2  # also far from the entity
    assert {rows[-1][1][m[0] : m[2]] for m in found[200] if m[1] == 4} == {"copy", "Yvonne"}
    fixed = {r["doc_id"]: r["text"] for r in pii.sanitize(docs).collect()}
    assert "[TERM] writes to [EMAIL]" in fixed[0] and fixed[0].endswith("Signed: [TERM]") and "Yvonne" not in fixed[200]
    assert not any(m[1] == 4 for i in range(100, 160) for m in found[i])


def test_many_matches_in_one_text(spark):
    """Tens of thousands of matches take time in proportion, in scans and in replacing them."""
    mails = "wörd a.b@c.de, " * 32000
    keys = "token=abcdef; " * 32000
    docs = spark.createDataFrame([(1, mails), (2, keys)], "doc_id long, text string")
    began = time.time()
    private = {r["doc_id"]: r["text"] for r in pii.sanitize(docs).collect()}
    redacted = {r["doc_id"]: r["text"] for r in secrets.redact(docs).collect()}
    assert time.time() - began < 60
    assert private[1].count("[EMAIL]") == 32000 and "@" not in private[1]
    assert redacted[2] == "[ASSIGN]; " * 32000 and redacted[1] == mails


def test_an_index_table_finds_the_same(spark):
    docs = spark.createDataFrame([(i if i % 5 else None, t) for i, t in enumerate(SECRETS)] + [(1, SECRETS[1]), (1, SECRETS[0])], "doc_id long, text string")
    asked = sorted(set().union(*(secrets.trigrams(secrets.trigram_query(r.pattern)) for r in secrets.RULES)))
    index = secrets.build_index(docs, asked)
    order = lambda df: sorted((r["id"] or -1, r["marks"]) for r in df.collect())
    assert order(secrets.scan(docs, index=index)) == order(secrets.scan(docs))
    assert sorted(map(str, secrets.redact(docs, index=index).collect())) == sorted(map(str, secrets.redact(docs).collect()))


def test_a_scan_goes_through_its_index(spark, monkeypatch):
    """Candidates come from postings alone, also where rows share an id or have none."""
    texts = ["token=abcdefgh", "AKIA" + "Z9" * 8, "deadbeef" * 3, "nothing", None]
    rows = [(i, t) for t in texts for i in (1, None)] + [(2, "ghp_" + "a" * 36)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    want = sorted((i or 0, sorted(secret_model(t or ""))) for i, t in rows if i != 2)
    found = secrets.scan(docs).where("id IS NULL OR id <> 2").collect()
    assert sorted((r["id"] or 0, sorted((m["s"], m["k"], m["e"]) for m in r["marks"])) for r in found) == want
    build = secrets.build_index
    monkeypatch.setattr(secrets, "build_index", lambda *a, **k: build(*a, **k).where("gram <> 'tok'"))
    left = {r["text"] for r in secrets.redact(docs).collect()}
    assert "token=abcdefgh" in left and "[ACCESS]" in left and "[HEX]" in left and "[GITHUB]" in left
