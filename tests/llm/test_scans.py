"""License, secret, language, quality and URL scans against brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest

from millrace.llm import langid, licenses, quality, secrets, urls

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ODD = [(900, None), (901, ""), (902, " \n\t "), (903, "é" * 3000 + " ok"), (904, "word " * 5000)]


def base_places(text):
    w = WORD.findall((text or "").translate(LOWER))
    phrases = {"mit": "the mit license".split(), "apache-2": "apache license version 2".split(), "cc-by-nc": "cc by nc".split()}
    places = [(i, k) for k, p in phrases.items() for i in range(len(w)) if w[i : i + len(p)] == p]
    return len(w), len(places), min(places)[0] if places else None, max(places)[0] if places else None, ",".join(sorted({k for _, k in places}))


def test_license_base_counts_and_spans(spark):
    rng = random.Random(3)
    mit, gpl = licenses.TEMPLATES[0][1], licenses.TEMPLATES[3][1]
    bits = ["The MIT License", "the mit", "license", "Apache License, Version 2.0", "CC BY-NC", "cc by nc by nc", "word", "İ the mit license", "apache license version"]
    docs = [(i, " ".join(rng.choice(bits) for _ in range(rng.randrange(12)))) for i in range(60)] + ODD
    words = mit.split()
    docs += [(100, "intro " + mit + " end"), (101, "a b " + " ".join(words[:20] + ["inserted"] + words[20:])), (102, " ".join(words[:8])), (103, gpl + " and " + mit)]
    docs += [docs[3], docs[3]]
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, label int").repartition(3)
    got = licenses.scan(df).collect()
    text = dict(docs)
    assert Counter(r.doc_id for r in got) == Counter(d for d, _ in docs)
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base_places(text[r.doc_id])
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    labels = {r.doc_id: r.labels for r in got}
    assert (labels[100], labels[101], labels[102], labels[103]) == ("mit", "mit", "", "gpl,mit")
    spans = {r.doc_id: [(s.first, s.label) for s in r.spans] for r in got}
    assert spans[100] == [(1, "mit")] and spans[101] == [(2, "mit")]
    assert licenses.scan(df.limit(0)).collect() == []


def test_license_query_counts_the_phrases_of_the_contract(spark, tmp_path):
    from millrace.llm.queries import op3_license_scan

    rng = random.Random(11)
    phrases = {"mit": "under the mit license".split(), "apache-2": "apache license version 2".split(), "cc-by-nc": "cc by nc".split()}
    bits = ["Under\nthe MIT-License", "The MIT License", "under the", "mit license", "Apache License, Version 2.0", "apache license version", "CC BY-NC", "by nc", "under thé mit license", "\x00word"]
    docs = [(i, " ".join(rng.choice(bits) for _ in range(rng.randrange(12)))) for i in range(60)] + ODD
    docs += [(200, "The MIT License"), (201, "x Under the MIT License under the mit license"), (None, "under the mit license"), (None, None), docs[3], docs[3], (3, "under the mit license")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))

    def brute(text):
        w = WORD.findall((text or "").translate(LOWER))
        places = [(i, k) for k, p in phrases.items() for i in range(len(w)) if w[i : i + len(p)] == p]
        at = [i for i, _ in places]
        return len(w), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({k for _, k in places}))

    got = Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in op3_license_scan(spark, str(tmp_path)).collect())
    assert got == Counter((d, *brute(t)) for d, t in docs)
    assert got[(200, 3, 0, None, None, "")] == 1 and got[(201, 9, 2, 1, 5, "mit")] == 1


def test_secret_base_spans(spark):
    rng = random.Random(4)
    bits = ['token = "24be64439e3e49cf46b2d7c9"', "AKIA" + "Q" * 16, "AKIAshort", "password: abc", "API_KEY=A1b2C3d4E5f6", "deadbeefdeadbeef", "apikey:'x.y/z+123456'", "ſecret = abcdefghijklmno", "plain é text", "PASSWD\t=\tabcdefghijklm", "secret:token: abcdefghijklmnop"]
    docs = [(i, " ".join(rng.choice(bits) for _ in range(rng.randrange(8)))) for i in range(80)] + ODD
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, spans string")
    assign = re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD])|(?:[pP][aA][sS][sS][wW][dD])|(?:[sS][eE][cC][rR][eE][tT])|(?:[tT][oO][kK][eE][nN])|(?:[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    for r in secrets.scan(df).collect():
        t = dict(docs)[r.doc_id] or ""
        want = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m.group(2)) >= 12]
        want += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m.group()) >= 18]
        want += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m.group()) >= 16]
        shown = ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in sorted(want))
        assert r.base_sha256 == hashlib.sha256(shown.encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == i for _, k, _ in want) for i in range(3)]
        assert [x for x in r.spans.split(",") if x and "entropy" not in x] == [x for x in shown.split(",") if x]
    assert secrets.scan(df.limit(0)).collect() == []


def license_labels(text):
    """Labels by all pairs of words: chained diagonals, and of each chain the stretch that covers most."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(LOWER))
    out = set()
    for label, body in licenses.TEMPLATES:
        t = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", body.translate(LOWER))
        votes = sorted((p - a, p, a) for p in range(len(w) - 2) for a in range(len(t) - 2) if w[p : p + 3] == t[a : a + 3])
        chains = []
        for v in votes:
            if chains and v[0] - chains[-1][-1][0] <= licenses.SLACK:
                chains[-1].append(v)
            else:
                chains.append([v])
        for chain in chains:
            for _, first, _ in chain:
                ats = {a for _, p, a in chain if 0 <= (p - first) / len(t) <= licenses.STRETCH}
                if len({a + i for a in ats for i in range(3)}) >= licenses.COVER * len(t):
                    out.add(label)
    return out | {label for label, phrase in licenses.BASE if f" {phrase} " in f" {' '.join(w)} "}


def test_license_labels_match_brute_force(spark):
    rng = random.Random(3)
    isc = dict(licenses.TEMPLATES)["isc"]
    docs = [(0, isc), (1, isc + " in all copies" * 8), (2, "in all copies " * 9 + isc), (3, " ".join(isc.split()[:12])), (4, isc.replace("software", "small program"))]
    for i in range(60):
        words = rng.choice(licenses.TEMPLATES)[1].split()
        for _ in range(rng.randrange(0, 12)):
            words[rng.randrange(len(words))] = "odd"
        cut = rng.randrange(len(words))
        docs.append((10 + i, "some words " * rng.randrange(4) + " ".join(words[cut:] + words[:cut] if i % 3 == 0 else words) + " " + rng.choice(licenses.BASE)[1] * (i % 2)))
    got = {r.doc_id: set(filter(None, r.labels.split(","))) for r in licenses.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    want = {d: license_labels(t) for d, t in docs}
    assert got == want and "isc" in want[1] and "isc" not in want[3]


def entropy(part):
    return -sum(n / len(part) * math.log2(n / len(part)) for n in Counter(part).values())


def test_entropy_windows_and_allow_list():
    rng = random.Random(5)
    for _ in range(50):
        word = "".join(rng.choice("abcdefgh0123456789XYZ"[: rng.randrange(3, 21)]) for _ in range(rng.randrange(20, 60)))
        hot = [i for i in range(len(word) - 19) if entropy(word[i : i + 20]) >= 3.0 - 1e-12]
        marked = {j for i in hot for j in range(i, i + 20)}
        found = secrets.hot_stretches(word, 3.0)
        assert {j for a, b in found for j in range(a, b)} == marked
    key = "q7Rt2Xv9Lm4Kp8Zw3Ns6Yb1"
    assert secrets.find(f"key {key} end") == [(4, 3, 4 + len(key))]
    for clean in ("Verantwortungsbewusstsein", "12345678901234567890123", "550e8400-e29b-41d4-a716-446655440000", "path/to/some/module2/file_name", "your_secret_key_q7Rt2Xv9Lm4Kp8"):
        assert [k for _, k, _ in secrets.find(clean) if k == 3] == []


def test_random_keys_of_each_form_are_found_and_public_digests_are_not():
    rng = random.Random(4)
    some = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    forms = [lower + digits, upper + digits, lower + upper + digits, lower + upper + digits + "+/"]
    for letters in forms:
        for around in ("{}", "see {} here", "/example/{}", "key={}", "sha {}", "nashasha: {}"):
            key = "7" + some(letters, 40) + "9"
            found = [(a, b) for a, k, b in secrets.find(around.format(key)) if k == 3]
            at = around.index("{")
            assert found and sum(min(b, at + 42) - max(a, at) for a, b in found) >= 30, around.format(key)
    letters_only = [some(lower + upper, 40) for _ in range(20)]
    assert sum(bool(secrets.find(k)) for k in letters_only) >= 18
    digest = "DA39A3EE5E6B4B0D3255BFEF95601890AFD80709"
    assert secrets.find(f"sha1: {digest}") == [] != secrets.find(f"value: {digest}")
    for clean in ("anIdentifierThatHasSeveralWords", "some_module_name2/another_part10", "internationalisierungsbemühungen"):
        assert secrets.find(clean) == []


def test_a_long_text_full_of_secrets_takes_time_in_proportion():
    import time

    key = "24be64439e3e49cf46b2d7c9"
    began = time.monotonic()
    assert len(secrets.find(f"token = {key} q7Rt2Xv9Lm4Kp8Zw3Ns6Yb1 " * 10_000)) >= 30_000
    assert not secrets.find("z" * 1_000_000 + "_")
    assert time.monotonic() - began < 15


def test_redaction_keeps_rows_and_other_columns(spark):
    df = spark.createDataFrame([(1, 'a token = "24be64439e3e49cf46b2d7c9" b', 5), (2, "clean", 6), (3, None, 7)], "doc_id long, text string, n int")
    assert sorted(map(tuple, secrets.redact(df).collect())) == [(1, 'a [SECRET]" b', 5), (2, "clean", 6), (3, None, 7)]


def test_language_held_out_accuracy_and_und(spark):
    rng = random.Random(6)
    parts = {"en": ["the", "ing", "tion", "and", "wh"], "de": ["sch", "ung", "der", "ß", "ei"], "fr": ["eau", "é", "le", "oi", "ç"]}
    docs = []
    for i in range(300):
        lang = rng.choice(list(parts))
        docs.append((i, " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(3, 60))), lang if i % 10 else None, lang))
    train = spark.createDataFrame([d[:3] for d in docs[:200]], "doc_id long, text string, lang string")
    test = spark.createDataFrame([(d, t, "x") for d, t, _, _ in docs[200:]] + [(d, t, "x") for d, t in ODD] + [(910, "123 ...", "x")], "doc_id long, text string, lang_pred string")
    for sample in (None, 40):
        model = langid.train(train, sample_per_language=sample)
        got = {r.doc_id: r for r in langid.identify(test, model).collect()}
        truth = {d[0]: d[3] for d in docs[200:]}
        assert sum(got[d].lang_pred == x for d, x in truth.items()) >= 0.97 * len(truth)
        assert all(got[d].lang_pred == "und" and got[d].score == 0 for d in (900, 901, 902, 910))
        assert all(0 <= r.score <= 1 for r in got.values()) and got[903].lang_pred != "und"
    nothing = langid.train(train.limit(0))
    assert {r.lang_pred for r in langid.identify(test, nothing).collect()} == {"und"}


def test_language_pieces_do_not_change_predictions():
    model = ["a", "b"], langid.log_table(langid.np.random.default_rng(1).random((2, langid.BUCKETS)) * 5)
    text = "some words éß and more " * 50
    whole, sums = langid.predict([text, "x"], *model)
    old = langid.pieces.__defaults__
    try:
        langid.pieces.__defaults__ = (37,)
        cut, sums2 = langid.predict([text, "x"], *model)
    finally:
        langid.pieces.__defaults__ = old
    assert whole == cut and langid.np.allclose(sums, sums2)


def quality_brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    times = Counter(windows)
    covered = {j for i, w in enumerate(windows) if times[w] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n, r = len(words), len(covered)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), r, n < 20 or 100 * r > 30 * n


def test_quality_measures(spark):
    rng = random.Random(8)
    docs = ODD[:]
    for i in range(120):
        words = [rng.choice(["the", "a", "und", "x#", "é|", "long", "\n", "\r", "\x0b", "\x85", "\x1c", " "]) for _ in range(rng.randrange(0, 80))]
        line = " ".join(words[:10])
        docs.append((i, " ".join(words) + ("\n" + line) * rng.randrange(3)))
    df = spark.createDataFrame([(d, t, 0) for d, t in docs], "doc_id long, text string, n_words int")
    for r in quality.judge(df).collect():
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        assert got == quality_brute(dict(docs)[r.doc_id]), r.doc_id
        assert not (r.kept and r.base_failed)
    assert quality.judge(df.limit(0)).collect() == []
    plan = quality.judge(df)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)


def test_quality_rules_are_a_table(spark):
    prose = "the cat and the dog of this house went to the sea with all that they had and more of it"
    df = spark.createDataFrame([(1, prose + " again"), (2, "### *** " * 20 + prose)], "doc_id long, text string")
    assert {r.doc_id: r.kept for r in quality.judge(df).collect()} == {1: True, 2: False}
    loose = [quality.Rule("any", "n_words", low=1)]
    short = spark.createDataFrame([(1, prose + " xyz")], "doc_id long, text string")
    assert quality.judge(short, rules=loose).first().kept


RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "", "block")]


def url_brute(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    host = host.translate(LOWER)
    fits = [(len(h + p), v, h + p) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best[2] if best else None, best[1] if best else "allow"


@pytest.mark.parametrize("few", [True, False])
def test_urls(spark, monkeypatch, few):
    if not few:
        monkeypatch.setattr(urls, "BROADCAST_RULES", 1)
    tails = ["/en/", "/en/71", "/en/8?x=1", "/de/8#a", "/de/9", "", "?q=/en/", "/EN/7", "/" + "p" * 5000, "//x://y/en/7"]
    hosts = ["example.com", "A.Example.COM", "notexample.com", "com", "example.net", "x.org", "org", "é.net", "", ".com"]
    pages = [(i, f"http://{h}{t}", "keep") for i, (h, t) in enumerate((h, t) for h in hosts for t in tails)]
    pages += [(500, None, ""), (501, "no scheme", ""), (502, "x\ny://a.com/en/", ""), (3, pages[3][1], "again"), (None, "http://a.org", "")]
    df = spark.createDataFrame(pages, "page_id long, url string, host string")
    rules = spark.createDataFrame(RULES + RULES[:1] + [("net", "/de/", "block")], "host string, path string, verdict string").where("NOT (host = 'net' AND verdict = 'block')")
    got = Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.judge(df, rules).collect())
    assert got == Counter((i, *url_brute(u)) for i, u, _ in pages)
    assert {r.verdict for r in urls.judge(df, rules.limit(0)).collect()} == {"allow"}
    assert urls.judge(df.limit(0), rules).collect() == []


def test_crc_split_is_that_of_the_contract(spark):
    import zlib

    from millrace.llm.queries import remainder

    rows = spark.createDataFrame([(i,) for i in range(50)], "doc_id long").select("doc_id", remainder("doc_id", 4).alias("r")).collect()
    assert all(r.r == zlib.crc32(str(r.doc_id).encode()) % 4 for r in rows)
