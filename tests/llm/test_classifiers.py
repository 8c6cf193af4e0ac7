import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import language_id as L
from skein.llm import queries as Q
from skein.llm import toxicity as T
from skein.llm import url_filter as U

SF = "/root/testdata/sf0.01"


def test_toxicity_on_held_out_labels(spark):
    got = Q.op1_toxicity(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out")
    assert got.where("predicted != toxic").count() <= 0.05 * got.count()  # from some 40 toxic labels
    assert Q.op1_toxicity(spark, SF).where("score < 0 or score > 1 or score is null").count() == 0
    rows = {r["doc_id"]: r["held_out"] for r in Q.op1_toxicity(spark, SF).collect()}
    assert all(h == (zlib.crc32(str(i).encode()) % 3 == 1) for i, h in rows.items())


def test_factorization_counts_pairs():
    rng = np.random.default_rng(0)
    m = T.Model(np.arange(6), 0.3, rng.normal(size=6), rng.normal(size=(6, 4)))
    at = np.array([0, 2, 5])
    pairs = sum(m.factors[i] @ m.factors[j] for i, j in itertools.combinations(at, 2))
    assert abs(m.logit(at) - (0.3 + m.weights[at].sum() + pairs)) < 1e-12


@pytest.mark.parametrize("filler", [0, 40])
def test_pairs_are_learned_where_single_terms_say_nothing(docs, spark, filler):
    rng = random.Random(3)
    rows, toxic = [], []
    for i in range(800):
        one, two = rng.random() < 0.5, rng.random() < 0.5
        words = ["insult"] * one + ["group"] * two + [f"w{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}" for _ in range(filler)]
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        toxic.append(int(one != two))
    labels = spark.createDataFrame([(i, toxic[i]) for i in range(600)], "doc_id long, toxic int")
    got = {r["doc_id"]: r["score"] for r in T.score(docs(rows), T.train(docs(rows), labels)).collect()}
    assert np.mean([(got[i] >= 0.5) == toxic[i] for i in range(600, 800)]) > (0.99 if not filler else 0.9)


def test_scores_equal_the_formula(spark):
    """Every score against the model's terms, worked out word by word and pair by pair."""
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    m = T.train(df, spark.read.parquet("/root/testdata/sf0.001/labels.parquet"))
    got = {r["doc_id"]: r["score"] for r in T.score(df, m).collect()}
    place = {int(t): i for i, t in enumerate(m.terms)}
    for r in df.collect()[:60]:
        at = sorted({place[t] for w in T.WORD.findall((r["text"] or "").lower()) for t in T.terms_of(w) if t in place})
        logit = m.bias + m.weights[at].sum() + sum(m.factors[i] @ m.factors[j] for i, j in itertools.combinations(at, 2))
        assert abs(got[r["doc_id"]] - 1 / (1 + np.exp(-logit))) < 1e-6


def test_labels_that_disagree_and_few_ids(docs, spark):
    rows = [(i, "bad thing" if i % 2 else "good thing") for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(1, 0)] * 3, "doc_id long, toxic int")
    models = [T.train(docs(rows), labels.repartition(n)) for n in (1, 5)]
    assert models[0].bias == models[1].bias and (models[0].weights == models[1].weights).all()
    many = T.train(docs(rows), labels.where("doc_id < 20").crossJoin(spark.range(50)), max_docs=100)
    assert len(many.terms) or many.bias != 0


def test_toxicity_edges(docs, edges, spark):
    labels = spark.createDataFrame([(4, 1), (5, 0), (None, 1), (1, None)], "doc_id long, toxic int")
    got = T.score(docs(edges), T.train(docs(edges), labels)).collect()
    assert len(got) == len(edges) and all(0 <= r["score"] <= 1 for r in got)
    nothing = T.train(docs([]), labels.limit(0))
    assert [r["score"] for r in T.score(docs([(1, "x")]), nothing).collect()] == [0.5]


def test_language_on_held_out_documents(spark):
    got = Q.op5_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.where("lang_pred != lang").count() <= 0.05 * got.count()
    rows = {r["doc_id"]: r["held_out"] for r in Q.op5_language_id(spark, SF).collect()}
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in rows.items())


def test_predictions_equal_the_rule_applied_word_by_word(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    m = L.train(df)
    got = {r["doc_id"]: r for r in L.identify(df, m).collect()}
    for r in df.collect():
        known = [s for w in L.words_of(r["text"] or "") if (s := m.of(w)) is not None]
        if not any(map(str.isalpha, r["text"] or "")):
            assert (got[r["doc_id"]]["lang_pred"], got[r["doc_id"]]["score"]) == ("und", 0.0)
            continue
        mean = np.mean(known, axis=0) if known else np.zeros(len(m.languages))
        e = np.exp((mean - mean.max()) * min(max(len(known), 1), 20))
        assert abs(got[r["doc_id"]]["score"] - e.max() / e.sum()) < 1e-6
        assert got[r["doc_id"]]["lang_pred"] == m.languages[int(np.argmax(np.round(mean, 9)))]


def test_what_is_a_letter(docs, spark):
    known = spark.createDataFrame([(i, "the house", "en") for i in range(5)] + [(7, "das Haus", "de")] * 3, "doc_id long, text string, lang string")
    m = L.train(known)
    rows = [(1, "½ ² Ⅷ 12 _"), (2, "½house"), (3, "ª"), (4, "the " * 120_000), (5, " ".join(f"x{i}" for i in range(400_000)))]
    got = {r["doc_id"]: r["lang_pred"] for r in L.identify(docs(rows), m).collect()}
    assert got[1] == "und" and got[2] == "en" and got[3] != "und" and got[4] == "en" and got[5] != "und"


def test_language_backs_off_and_edges(docs, edges, spark):
    known = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate([("the house and the garden", "en"), ("das Haus und der Garten", "de")] * 5)], "doc_id long, text string, lang string")
    m = L.train(known)
    assert m.languages == ["de", "en"] and m.of("garden")[1] > m.of("garden")[0]
    assert "gartens" not in m.words and m.of("gartens")[0] > m.of("gartens")[1]  # by its n-grams
    assert m.of("日") is None
    got = {(r["doc_id"], r["lang_pred"], r["score"] > 0) for r in L.identify(docs(edges), m).collect()}
    assert {(1, "und", False), (2, "und", False), (3, "und", False), (6, "und", False)} <= got
    assert L.identify(docs(edges), m).count() == len(edges) and L.identify(docs([]), m).count() == 0
    assert {r["lang_pred"] for r in L.identify(docs([(1, "text")]), L.train(known.limit(0))).collect()} == {"und"}


def rule_by_hand(url):
    host = path = ""
    if url and "://" in url:
        rest = url[url.index("://") + 3 :]
        cut = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
    fits = [r for r in Q.URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.host + r.path), default=None)
    return host, path, best.host + best.path if best else None, best.verdict if best else None


def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "http://A.Example.ORG/es/1?x#y", "http://example.org", "http://example.org/en/12", "https://xexample.org/es/2", "http://b.com/de/3#t", "http://b.com/fr/", "http://b.com?x=/de/", "http://É.Com/de/1", "a://b://c/d", "http://b.com/x\ny", "http://org/", "http://b.com/de/3#t", "http://casino-bets.net/" + "x" * 5000]
    df = spark.createDataFrame([(i, u, "a", "b", 1) for i, u in enumerate(urls)], "page_id long, url string, host string, rule string, score int")
    got = {r["page_id"]: r for r in U.filter_urls(df, Q.URL_RULES).collect()}
    for i, u in enumerate(urls):
        host, path, rule, verdict = rule_by_hand(u)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule), u
        assert got[i]["verdict"] == (verdict or ("block" if got[i]["score"] >= 0.5 else "allow"))
        assert (host, path) == U.split_url(u)
    assert got[16]["verdict"] == "block" and U.filter_urls(df.limit(0), Q.URL_RULES).count() == 0


#: Urls of hosts that aren't in the table, many with a blocked word's letters in an innocent name.
UNSEEN_ALLOWED = """essex.ac.uk middlesex.net medscape.com pharmacy.gov/licence hackaday.com antivirus.net cracker-barrel.net nytimes.com/2024/01/02/world amazon.com/dp/123 mit.edu/courses betsyross.org
arsenal.com/fixtures cam.ac.uk analog.com/parts python.org/docs sexton-bakery.co.uk assassinscreed.com expertsexchange.com therapist.org loanwords.org/dictionary""".split()
UNSEEN_BLOCKED = """pornhub.com bet365.com xvideos.com secure-paypal-verify.net sportsbook.net redtube.com youporn.com 888casino.com pokerstars.com partypoker.com williamhill.com/betting ladbrokes.com/odds
xhamster.com viagra-online.biz generic-cialis.com thepiratebay.org/torrents onlinecasino.de betfair.com unibet.com adultfriendfinder.com chaturbate.com payday-advance.com login-microsoft-verify.com/account replica-handbags.net""".split()


def test_url_model_on_urls_that_it_has_not_seen():
    m = U.train()
    blocked = lambda u: m.bias + m.part("h", U.split_url(u)[0]) + m.part("p", U.split_url(u)[1]) >= 0
    hosts = {u.partition("/")[0] for u in [*U.BLOCKED_URLS, *U.ALLOWED_URLS]}
    assert not hosts & {u.partition("/")[0] for u in [*UNSEEN_ALLOWED, *UNSEEN_BLOCKED]}
    alarms = [u for u in UNSEEN_ALLOWED if blocked(f"http://{u}")]
    misses = [u for u in UNSEEN_BLOCKED if not blocked(f"http://{u}")]
    assert len(alarms) <= 3 and len(misses) <= 8, (alarms, misses)
    for u in ("http://bestcasino777.com", "https://phishing-login.xyz", "http://cheap-viagra-pills.ru/x", "https://freeporn.tv"):
        assert blocked(u), u
    for u in ("http://shop.net/en/1", "https://example.net/en/37", "http://www.cityweather.org/today", "https://blog.someone.com/post", "http://qwrtz.net/es/5"):
        assert not blocked(u), u


def test_url_model_on_hosts_held_out_of_its_table():
    """Many words stand in one row only, and the innocent hosts are mostly such as hold a blocked word's letters: on these the
    model is far from certain, but better than chance."""
    part = lambda urls, own: [u for i, u in enumerate(urls) if (i // (len(U.ENDINGS) + 1) % 5 == 0) == own]
    block, allow = U.labelled()
    m = U.train(part(block, False), part(allow, False))
    score = lambda u: m.bias + m.part("h", U.split_url(u)[0]) + m.part("p", U.split_url(u)[1])
    found = np.mean([score(u) >= 0 for u in part(block, True)])
    alarms = np.mean([score(u) >= 0 for u in part(allow, True)])
    assert found > 2 * alarms, (found, alarms)




def test_many_letters_and_few_remembered_words(docs, spark, monkeypatch):
    known = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate([("the house and the garden", "en"), ("das Haus und der Garten", "de")] * 5)], "doc_id long, text string, lang string")
    m = L.train(known)
    texts = ["gardens houses theory", "Gärten hauses derart", "x", "the das", "unknown Wörter 日本", ""]
    whole = L.Table(m).totals(texts)
    few = L.Table(m, at_most=2).totals(texts)
    monkeypatch.setattr(L.Table, "BITS", 2)
    assert not L.Table(m).packs
    for other in (few, L.Table(m).totals(texts)):
        assert np.allclose(whole, other)
    for text, total in zip(texts, whole):
        scores = [s for w in L.words_of(text) if (s := m.of(w)) is not None]
        assert total[-1] == len(scores) and np.allclose(total[:-1], np.sum(scores, axis=0) if scores else 0)
