"""URL rules, source mixing, multiset fingerprints, personal data and revisits against brute force."""

import collections
import hashlib
import random
import re

from pyspark.sql import functions as F

from ledgerlens.llm.mixing import mix_sources
from ledgerlens.llm.multiset_fingerprint import as_text, combined, fingerprint_edits, with_fingerprint
from ledgerlens.llm.pii import PRECISION, RECALL, calibrated, detect, digest_spans, find_spans, marked, redact, score_proposals
from ledgerlens.llm.url_rules import judge_urls
from ledgerlens.llm.warc import canonical_url, resolve_revisits

from .conftest import words

# --- URL rules


def _judge(url, rules):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "", re.S)
    host, path = (m[1].lower(), m[2]) if m else ("", "")
    fits = [(-len(h + p), v != "block", h + p, v) for h, p, v in rules
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = min(fits, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


def test_url_rules_equal_brute_force(spread):
    rnd = random.Random(3)
    names, tops, parts = ["a", "b", "www", "x-1"], ["com", "net", "b.org"], ["", "/", "/en", "/en/", "/en/a/b", "/é/"]
    rules = [("com", "/", "allow"), ("a.com", "/en/", "block"), ("a.com", "/en/a/", "allow"), ("www.a.com", "/en/", "allow"),
             ("net", "/é/", "block"), ("b.org", "", "block"), ("x.b.org", "", "allow"), ("x.b.org", "", "block"), ("b.org", "", "block")]
    urls = [None, "", "no scheme/com/", "http://", "http://A.COM:80/en/", "x://com/", "ftp://a.com?x://net/en/", "http://a.com./en/",
            "http://é.net/é/\nx", "http://a.com/en/a/b"] * 2
    urls += [f"http{rnd.choice(['', 's'])}://" + ".".join(rnd.sample(names, rnd.randint(0, 3)) + [rnd.choice(tops)])
             + rnd.choice(parts) + rnd.choice(["", "?q=/en/", "#/en/"]) for _ in range(200)]
    urls += ["https://hot.a.com/en/"] * 300
    pages = spread.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumns({"path": F.lit("mine"), "stack": F.lit(1)})
    made = judge_urls(pages, spread.createDataFrame(rules, "rule_host string, rule_path string, rule_verdict string"))
    assert set(made.columns) == {"page_id", "url", "stack", "host", "path", "rule", "verdict"}
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in made.collect()}
    assert got == {i: _judge(u, rules) for i, u in enumerate(urls)}


def test_url_rules_without_rules_or_pages(spark):
    rules = spark.createDataFrame([], "rule_host string, rule_path string, rule_verdict string")
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    assert [(r.rule, r.verdict) for r in judge_urls(pages, rules).collect()] == [(None, "allow")]
    assert judge_urls(pages.limit(0), rules).count() == 0

# --- mixing


def test_mix_meets_targets(spread, odd_rows, odd_docs):
    got = mix_sources(odd_docs).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    per = {}
    for r in odd_rows:
        per[r[3]] = per.get(r[3], 0) + size(r[1])
    weights = {s: i % 3 + 1 for i, s in enumerate(sorted(per, key=lambda s: (s is None, s or "")))}
    left, target, free = sum(per.values()), {}, set(per)
    while True:                                      # reshare what capped sources leave
        level = left / sum(weights[s] for s in free)
        full = {s for s in free if weights[s] * level > 3 * per[s]}
        if not full:
            break
        target |= {s: 3 * per[s] for s in full}
        left, free = left - sum(3 * per[s] for s in full), free - full
    target |= {s: weights[s] * level for s in free}
    taken = {}
    for r in got:
        assert r.size == size(dict((x[0], x[1]) for x in odd_rows)[r.doc_id]) and 0 <= r.taken <= 3 * r.size
        assert r.source_size == per[r.source] and abs(r.target - target[r.source]) < 1e-6
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert len(got) == len(odd_rows) and all(abs(taken[s] - target[s]) < 1 + 1e-6 for s in per)
    assert sorted(map(repr, got)) == sorted(map(repr, mix_sources(odd_docs.repartition(3)).collect()))


def test_mix_of_a_smaller_budget_is_a_prefix(spread):
    rnd = random.Random(1)
    docs = spread.createDataFrame([(i, f"s{i % 2}", "w " * rnd.randint(1, 20)) for i in range(400)], "doc_id long, source string, text string")
    cut = mix_sources(docs, budget=1500).groupBy("source").agg(F.sum("taken").alias("n")).collect()
    assert sum(r.n for r in cut) == 1500
    by = {r.source: r.n for r in cut}
    assert abs(by["s1"] / by["s0"] - 2) < 0.1            # weights 1 and 2
    order = "doc_id", "taken", "mix_start"
    assert sorted(mix_sources(docs, budget=10**9).select(*order).collect()) == sorted(mix_sources(docs).select(*order).collect())


def test_the_queue_is_truncated_inside_a_document(spread):
    """Two sources of one long document each: the total budget ends inside both, at their targets."""
    docs = spread.createDataFrame([(1, "a", "w " * 1000), (2, "b", "w " * 1001)], "doc_id long, source string, text string")
    got = {r.source: r for r in mix_sources(docs).collect()}
    assert {s: (r.taken, r.target) for s, r in got.items()} == {"a": (667, 667.0), "b": (1334, 1334.0)}
    assert sum(r.taken for r in mix_sources(docs, budget=100).collect()) == 100


def test_mix_odd_rows(spark, no_docs):
    assert mix_sources(no_docs).count() == 0
    docs = spark.createDataFrame([(1, "a", "x y z")] * 2 + [(None, None, "x"), (3, "b", None)], "doc_id long, source string, text string")
    got = mix_sources(docs).collect()
    assert len(got) == 4 and sum(r.taken for r in got) <= 7

# --- fingerprints


def test_edits_and_fingerprints(spread, odd_rows, odd_docs):
    got = {r.doc_id: r for r in fingerprint_edits(odd_docs).collect()}
    rows = sorted((r[0], r[1] or "") for r in odd_rows)
    prints = {}
    for i, (d, t) in enumerate(rows):
        following, half = rows[(i + 1) % len(rows)][1], len(t) // 2
        edited = t[:len(t) - half] + following[:half]
        assert (got[d].n_chars, got[d].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        prints.setdefault(tuple(sorted(filter(None, t.split("\n")))), set()).add(got[d].fingerprint)
        if edited == t:
            assert got[d].near_edited == 1 and got[d].edited_fingerprint == got[d].fingerprint
    assert all(len(p) == 1 for p in prints.values()) and len(set().union(*prints.values())) == len(prints)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got.values())


def test_paragraphs_are_inserted_and_deleted(spark):
    texts = spark.createDataFrame([("a b c\nd, e f\ng h", "g h\n\na b c", "d, e f")], "whole string, some string, rest string")
    for name in texts.columns:
        texts = with_fingerprint(texts, F.col(name), f"fp_{name}")
    whole, some, rest = (F.col(f"fp_{n}") for n in ("whole", "some", "rest"))
    r = texts.select(as_text(whole), as_text(combined(some, rest)), as_text(combined(whole, rest, -1)), as_text(some)).first()
    assert r[0] == r[1] and r[2] == r[3] and r[0] != r[3]


def test_fingerprints_odd_rows(spark, no_docs):
    assert fingerprint_edits(no_docs).count() == 0
    one = fingerprint_edits(spark.createDataFrame([(1, "abcd")], "doc_id long, text string")).first()
    assert one.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and one.near_next == 1
    rows = [(None, "first"), (None, None), (2, "same text"), (2, "same text")]
    got = fingerprint_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 4 and len({r.fingerprint for r in got}) == 3

# --- personal data


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _luhn(s):
    d = [int(c) for c in reversed(s) if c.isdigit()]
    return sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(d)) % 10 == 0


def _base(text):
    ok = {"email": lambda m: True, "ip": lambda m: all(int(x) <= 255 for x in m.split(".")),
          "card": lambda m: 16 <= len(re.sub(r"[\x20-]", "", m)) <= 19 and _luhn(m),
          "phone": lambda m: 8 <= sum(c in "0123456789" for c in m) <= 15}
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text) if ok[k](m[0])]


PERSONAL = ["mail a.b%c@x-y.co.uk, or é@b.c x@y.z_q@r.s. and a@b@c.d a@b..c @x.y a@b.c+d@e.f", "1.2.3.4.5.6.7.8 256.1.1.1 01.002.3.255",
            "call +1 (988) 555-2485 or +12 3 +1(2)3.4-5 6 7 8 9+33 1 23 45 67 89.", "4753376719988201 4753 3767 1998 8201, 4753-3767-1998-8202 4753  3767",
            "é4753376719988201é 1 2 3", "+" * 50 + "1" * 3000, "a" * 5000 + "@", "1." * 3000, "1 " * 3000, "", None, "x@y.z" * 500]


def test_base_spans_equal_the_plain_patterns(spread):
    rows = list(enumerate(PERSONAL))
    got = {r.doc_id: r for r in digest_spans(detect(spread.createDataFrame(rows, "doc_id long, text string"))).collect()}
    for d, t in rows:
        want = _base(t or "")
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert [got[d][f"n_{k}"] for k in PATTERNS] == [sum(w[0] == k for w in want) for k in PATTERNS]
        assert got[d].base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert set(filter(None, text.split(","))) <= set(got[d].spans.split(","))


SPACED = ["call +1 2 3 4 5 6 7 8 now", "+1.2.3.4.5.6.7.8", "+1 (2) 3-4 5 6 7 8", "+ 1 2 3 4 5 6 7 8", "+1 2 3 4 5 6 7", "1 2 3 4 5 6 7 8",
          "x@y.z +1 2 3 4 5 6 7 8", "@ (at) [at] +"]


def test_base_spans_of_texts_without_adjacent_digits(spread):
    rows = list(enumerate(SPACED))
    got = {r.doc_id: r for r in digest_spans(detect(spread.createDataFrame(rows, "doc_id long, text string"))).collect()}
    for d, t in rows:
        want = _base(t)
        assert [got[d][f"n_{k}"] for k in PATTERNS] == [sum(w[0] == k for w in want) for k in PATTERNS]
        assert got[d].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
    assert sum(r.n_phone for r in got.values()) == 4


def test_boosted_proposals_add_spans_like_the_learned_ones(spark):
    rnd = random.Random(7)
    rows = []
    for i in range(600):
        tail = f"({rnd.randint(200, 999)}) 555-{rnd.randint(1000, 9999)}"
        mark = "+1 " if i % 10 else ""                 # every tenth without the sign that the base pattern needs
        rows.append((i, f"{words(rnd, 5)} phone {mark}{tail} {words(rnd, 4)} {rnd.randint(10, 99)}.{rnd.randint(100, 999)}-{rnd.randint(1000, 99999)}x"))
    got = digest_spans(detect(spark.createDataFrame(rows, "doc_id long, text string"), sample=3000)).collect()
    added = {r.doc_id for r in got if r.n_phone == 0 and "phone:" in r.spans}
    assert sum(r.n_phone for r in got) == 540
    assert added <= {i for i in range(0, 600, 10)} and len(added) > 30


def _card(rnd):
    d = [rnd.randint(0, 9) for _ in range(15)]
    return next(n for n in ("".join(map(str, d)) + str(k) for k in range(10)) if _luhn(n))


def test_disguised_ip_addresses_and_cards_are_proposed_and_added(spark):
    rnd, rows, want = random.Random(11), [], {}
    for i in range(600):
        ip, n = [str(rnd.randint(1, 255)) for _ in range(4)], _card(rnd)
        four, wrong = [n[k:k + 4] for k in range(0, 16, 4)], str(rnd.randint(300, 999))
        dot, gap = (rnd.choice(["[.]", " . ", " dot ", "(dot)"]), rnd.choice([".", " - ", "/"])) if i % 10 == 0 else (".", " ")
        head = f"{words(rnd, 3)} server "
        mid = f" {words(rnd, 3)} card "
        tail = f" {words(rnd, 2)} {wrong}[.]{wrong}[.]0[.]1 and {rnd.randint(10**14, 10**15)}.7.7"     # octets over 255, a failed rule
        shown, number = dot.join(ip), gap.join(four)
        text = head + shown + mid + number + tail
        rows.append((i, text))
        if i % 10 == 0:
            at = len(head + shown + mid)
            want[i] = {f"ip:{len(head)}:{len(head + shown)}", f"card:{at}:{at + len(number)}"}
    got = {r.doc_id: r for r in digest_spans(detect(spark.createDataFrame(rows, "doc_id long, text string"), sample=3000)).collect()}
    for i, text in rows:
        base = _base(text)
        assert (got[i].n_ip, got[i].n_card) == (sum(k == "ip" for k, _, _ in base), sum(k == "card" for k, _, _ in base))
    found = sum(len(w & set(got[i].spans.split(","))) for i, w in want.items())
    assert found > 0.8 * sum(map(len, want.values()))
    clean = [i for i in got if i not in want]
    wild = sum(len(set(got[i].spans.split(",")) - {f"{k}:{a}:{b}" for k, a, b in _base(rows[i][1])}) for i in clean)
    assert wild < 0.1 * len(clean)


def test_loose_generators_take_linear_time(spark):
    texts = ["1 " * 20000, "1." * 20000, "1 dot " * 8000, "12345678901234567890" * 2000, "1 . " * 8000, "1   " * 8000]
    rows, spans = find_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert rows.count() == len(texts) and spans.count() > 0


def test_found_spans_are_redacted(spark):
    docs = spark.createDataFrame([(1, "mail a@b.c or 1.2.3.4!"), (2, "nothing"), (3, None)], "doc_id long, text string")
    rows = docs.join(detect(docs), "doc_id").select("doc_id", redact(F.coalesce("text", F.lit("")), F.col("found")).alias("text"))
    assert dict(rows.collect()) == {1: "mail [email] or [ip]!", 2: "nothing", 3: ""}


def _rare_phones(rnd):
    """Phones, every tenth unmarked, beside 150 times as many e-mails, half of them copies of one text."""
    for i in range(100):
        mark = "+1 " if i % 10 else ""
        mails = " ".join(f"x{k if i % 2 else rnd.randint(0, 10**6)}@y.org" for k in range(150))
        yield i, (f"{mails} phone {mark}({rnd.randint(200, 999)}) 555-{rnd.randint(1000, 9999)} {words(rnd, 4)} "
                  f"{rnd.randint(10, 99)}.{rnd.randint(100, 999)}-{rnd.randint(1000, 99999)}x")


def test_a_rare_kind_is_calibrated_beside_a_hot_one(spark):
    docs = spark.createDataFrame(list(_rare_phones(random.Random(7))), "doc_id long, text string")
    got = digest_spans(detect(docs, sample=200)).collect()
    added = {r.doc_id for r in got if r.n_phone == 0 and "phone:" in r.spans}
    assert sum(r.n_phone for r in got) == 90
    assert added <= set(range(0, 100, 10)) and len(added) >= 5


def test_thresholds_are_those_of_all_proposals_outside_the_sample(spread):
    docs = spread.createDataFrame(list(_rare_phones(random.Random(8))), "doc_id long, text string")
    scored, thresholds = score_proposals(marked(find_spans(docs)[1]), sample=200)
    rows = scored.collect()
    n = collections.Counter(r.kind for r in rows if r.fitted)
    assert len(rows) > 15000 and 0 < n["phone"] <= 50 and n["email"] >= 25 and len(rows) - sum(n.values()) > 7000
    want = _thresholds([r for r in rows if not r.fitted])
    assert thresholds == want and set(want) >= {"email", "phone"}


def _thresholds(rows):
    out = {}
    for kind in {r.kind for r in rows}:
        positive = sorted((r.score for r in rows if r.kind == kind and r.inside), reverse=True)
        if positive:
            least = positive[int(RECALL * (len(positive) - 1))]
            if sum(x >= least for x in positive) >= PRECISION * sum(r.kind == kind and r.score >= least for r in rows):
                out[kind] = least
    return out


def test_calibration_equals_brute_force(spread):
    rnd = random.Random(9)
    share = {"email": 0.9, "ip": 0.5, "card": 0.0, "phone": 0.3}
    for _ in range(3):
        rows = [(k, round(min(1.0, rnd.random() * (0.5 + p)), rnd.choice([1, 3])), rnd.random() < p) for k, p in share.items() for _ in range(rnd.randint(1, 300))]
        made = spread.createDataFrame(rows, "kind string, score double, inside boolean")
        assert calibrated(made) == _thresholds(made.collect())
    assert calibrated(made.limit(0)) == {}


def test_personal_data_odd_rows(spark, no_docs):
    assert digest_spans(detect(no_docs)).count() == 0
    rows = [(1, "a@b.c"), (1, "a@b.c"), (None, "x 1.2.3.4"), (2, None)]
    found = detect(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id or 0, r.spans) for r in digest_spans(found).collect()) == [(0, "ip:2:9"), (1, "email:0:5"), (1, "email:0:5"), (2, "")]
    text = spark.createDataFrame([("mail a@b.c or 1.2.3.4!", [(5, 10, "email"), (14, 21, "ip")])],
                                 "text string, found array<struct<start:long,end:long,kind:string>>")
    assert text.select(redact(F.col("text"), F.col("found"))).first()[0] == "mail [email] or [ip]!"

# --- revisits


CAPTURE = ("record_id long, warc_type string, target_uri string, captured_at long, status int, headers map<string,string>, "
           "payload_digest string")


def test_revisits_equal_brute_force(spread):
    rnd = random.Random(2)
    rows = []
    for i in range(600):
        url = "http://hot.com/" if i % 3 else f"http://u{i % 20}.com/{i % 4}?b=1&ref=x"
        kind = rnd.choice(["response", "revisit", "revisit", "request"])
        tags = {k: rnd.choice(["1", "2"]) for k in rnd.sample(["etag", "last-modified", "vary", "server"], rnd.randint(0, 4))}
        rows.append((i, kind, url if i % 50 else None, rnd.randint(0, 200), rnd.choice([200, 200, 304, 404]), tags if i % 9 else None,
                     rnd.choice([None, "d1", "d2"])))
    got = {r.record_id: r for r in resolve_revisits(spread.createDataFrame(rows, CAPTURE)).collect()}
    key = lambda u: u and u.split("://")[1].replace("?b=1&ref=x", "?b=1").rstrip("/")
    allowed = {"etag", "last-modified", "vary"}
    for i, kind, url, at, status, headers, digest in rows:
        r, headers = got[i], headers or {}
        if kind == "response" and 200 <= status < 300:
            assert (r.outcome, r.payload_of, r.merged_headers, r.resolved_digest) == ("response", i, headers, digest)
            continue
        if kind != "revisit":
            assert r.outcome == "other" and r.payload_of is None
            continue
        earlier = [x for x in rows if url and x[2] and key(x[2]) == key(url) and x[1] == "response" and 200 <= x[4] < 300 and x[3] < at]
        if not earlier:
            assert (r.outcome, r.refers_to) == ("no_response", None)
            continue
        last = max(earlier, key=lambda x: (x[3], x[0]))
        theirs = last[5] or {}
        same = None
        for tag in ("etag", "last-modified"):
            if same is None and tag in headers and tag in theirs:
                same = headers[tag] == theirs[tag]
        if same is None and digest and last[6]:
            same = digest == last[6]
        assert r.refers_to == last[0]
        assert r.outcome == {None: "no_validator", True: "resolved", False: "changed"}[same]
        merged = {**theirs, **{k: v for k, v in headers.items() if k in allowed}} if same else headers
        assert (r.merged_headers, r.payload_of, r.resolved_digest) == (merged, last[0] if same else None, last[6] if same else None)


def test_canonical_urls_and_odd_rows(spark):
    urls = {"HTTP://u@WWW.A.com:80/x/index.html?b=2&a=1&utm_x=3#f": "a.com/x?a=1&b=2", "https://a.com": "a.com", "https://a.com/?": "a.com",
            "a.com/x": None, "http:///x": None, "http://a.com/X/?ref=1": "a.com/X"}
    got = spark.createDataFrame([(u,) for u in urls], "u string").select("u", canonical_url(F.col("u")).alias("c")).collect()
    assert {r.u: r.c for r in got} == urls
    empty = spark.createDataFrame([], CAPTURE)
    assert resolve_revisits(empty).count() == 0
    rows = [(1, "response", "http://a/", None, 200, None, "d"), (2, "revisit", "http://a/", 5, None, None, "d"), (None, None, None, None, None, None, None)]
    twice = spark.createDataFrame(rows * 2, CAPTURE).withColumn("outcome", F.lit("mine"))
    out = resolve_revisits(twice).collect()
    assert sorted(r.outcome for r in out) == ["other"] * 2 + ["resolved"] * 2 + ["response"] * 2
