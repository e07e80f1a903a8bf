import math
import re
from collections import defaultdict

import numpy as np

from textward.llm import langid
from textward.llm.queries import QUERIES

SETTINGS = langid.Settings(languages=("de", "en"), buckets=4096)


def test_visible_text():
    page = "<html><style>p{}</style><!-- no --><p>One &amp; two<script>var x='<b>'</script><br>three < four</p> end <b"
    assert langid.visible(page).split() == ["One", "&", "two", "three", "<", "four", "end", "<b"]
    assert langid.visible("<" * 50_000).count("<") == 50_000


def test_trigram_counts_are_those_of_the_texts(spark):
    texts = spark.createDataFrame([("der die das", "de"), ("the that", "en"), (None, "en"), ("le la", "fr"), ("x", None)], "text string, lang string")
    table = np.exp(langid.train(texts, SETTINGS))
    counts = np.full((4096, 2), 0.5)
    for column, text in enumerate(("der die das", "the that")):
        for b in langid.trigrams(text, 4096):
            counts[b, column] += 1
    assert np.allclose(table, counts / counts.sum(axis=0)) and np.allclose(table.sum(axis=0), 1)


def test_pages_of_the_tables(spark):
    sf = "/root/testdata/sf0.01"
    truth = {i: re.search(r"/(en|fr|de|es)/", u)[1] for i, u in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url").collect()}
    rows = QUERIES["op9_language_id"](spark, sf).collect()
    assert len(rows) == len(truth) and sum(truth[r.page_id] == r.lang for r in rows) >= 0.98 * len(rows)


def test_evidence_decides_where_the_text_does_not(spark):
    texts = spark.createDataFrame([("der die das und nicht ein eine " * 20, "de"), ("the that and not one with are " * 20, "en")], "text string, lang string")
    german, english = "<html lang=de><p>" + "die und nicht eine " * 30, "<html lang='en-GB'><p>" + "the and not with " * 30
    rows = [(i, "http://a.shop.de/x", german) for i in range(20)] + [(i, "//b.shop.com:80/", english) for i in range(20, 40)]
    rows += [(40, "https://c.shop.de/", "<html lang=de>"), (41, "http://a.shop.de/empty", None), (42, None, "<p>12"), (43, "no address", english), (43, "no address", english)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in langid.identify(pages, texts, SETTINGS).collect()}
    assert all(got[i].lang == "de" for i in [*range(20), 40, 41]) and all(got[i].lang == "en" for i in [*range(20, 40), 43])
    assert got[40].host == "c.shop.de" and got[42].host == "" and got[40].probability > 0.8
    assert langid.identify(pages, texts, SETTINGS).count() == 45
    assert langid.identify(pages.limit(0), texts, SETTINGS).count() == 0
    assert langid.identify(pages, texts.limit(0), SETTINGS).count() == 45


def plain_bucket(triple, buckets):
    return ((triple[0] << 16 | triple[1] << 8 | triple[2]) * 0x9E3779B97F4A7C15 % (1 << 64) >> 40) % buckets


def plain_buckets(text, buckets):
    b = text.lower().encode("utf-8", "replace")
    return [plain_bucket(b[i : i + 3], buckets) for i in range(len(b) - 2)]


def softmax(logs):
    raised = [math.exp(x - max(logs)) for x in logs]
    return [x / sum(raised) for x in raised]


def plain_identify(pages, texts, s):
    """page_id to (host, declared, language of the text, language, probability), one page and one number at a time."""
    k = len(s.languages)
    counts = [defaultdict(int) for _ in range(k)]
    for text, lang in texts:
        if lang in s.languages:
            for b in plain_buckets(text or "", s.buckets):
                counts[s.languages.index(lang)][b] += 1
    totals = [sum(c.values()) + s.smoothing * s.buckets for c in counts]
    seen = []
    for page_id, url, page in pages:
        host = re.match(r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:@\s]+)", url or "")
        host = host[1].lower() if host else ""
        declared = re.search(r"(?i)<html\b[^<>]*?\blang\s*=\s*[\"']?\s*([A-Za-z]{2,8})", page or "")
        logs = [0.0] * k
        for b in plain_buckets(langid.visible(page or ""), s.buckets):
            for l in range(k):
                logs[l] += math.log((counts[l][b] + s.smoothing) / totals[l])
        logs = [x * s.text_share for x in logs]
        parts = host.split(".")
        seen.append((page_id, host, ".".join(parts[-2:]), parts[-1], declared[1].lower() if declared else "", logs, softmax(logs)))

    def sums(column):
        out = defaultdict(lambda: [0.0] * k)
        for row in seen:
            out[row[column]] = [a + b for a, b in zip(out[row[column]], row[6])]
        return out

    of_host, of_domain, of_suffix, of_declared = (sums(c) for c in (1, 2, 3, 4))
    every = [sum(row[6][l] for row in seen) for l in range(k)]
    result = {}
    for page_id, host, domain, suffix, declared, logs, alone in seen:
        without = lambda n: [max(a - b, 0.0) for a, b in zip(n, alone)]

        def level(n, above):
            return [(a + s.prior_pages * p) / (sum(n) + s.prior_pages) for a, p in zip(n, above)]

        prior = level(without(every), [1 / k] * k)
        prior = level(without(of_domain[domain]), prior)
        prior = level(without(of_host[host]), prior)
        total = [x + math.log(p) for x, p in zip(logs, prior)]
        for value, table in ((declared, of_declared), (suffix, of_suffix)):
            if value:
                total = [
                    t + math.log((a + s.evidence_smoothing) / (b + s.evidence_smoothing * len(table)))
                    for t, a, b in zip(total, without(table[value]), without(every))
                ]
        posterior = softmax(total)
        best = lambda p: s.languages[p.index(max(p))]
        result[page_id] = (host, declared, best(alone), best(posterior), max(posterior))
    return result


def test_query_against_one_page_at_a_time(spark):
    sf = "/root/testdata/sf0.001"
    pages = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    texts = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("text", "lang").collect()]
    want = plain_identify(pages, texts, langid.Settings())
    rows = QUERIES["op9_language_id"](spark, sf).collect()
    assert len(rows) == len(want)
    for r in rows:
        host, declared, alone, lang, probability = want[r.page_id]
        assert (r.host, r.declared, r.text_lang, r.lang) == (host, declared, alone, lang)
        assert math.isclose(r.probability, probability, rel_tol=1e-9)
