import math

import xxhash

from barloom.llm import urlfilter as U

PAGES = "page_id long, url string, html string"


def verdicts(spark, urls, labelled=None, **more):
    rows = [(i, u, "x") for i, u in enumerate(urls)]
    labelled = U.labelled_table(spark) if labelled is None else labelled
    return [r for r in U.judge(spark.createDataFrame(rows, PAGES), labelled, **more).orderBy("page_id").collect()]


def test_parts_rules_and_longest_wins(spark):
    got = verdicts(spark, [
        "http://WWW.Example.NET/en/1?a=b", "https://a.example.net/fr/1", "x://net", "y://sub.net/", "http://notnet.example.org/fr/2#q",
        "http://m.example.com/de/1", "http://badexample.com/de/1", None, "no scheme", "", "http://É.example.org/Fr/1"])
    assert [(r["host"], r["path"], r["rule"]) for r in got] == [
        ("www.example.net", "/en/1", "example.net/en/"), ("a.example.net", "/fr/1", "net/"), ("net", "", None),
        ("sub.net", "/", "net/"), ("notnet.example.org", "/fr/2", "org/fr/"), ("m.example.com", "/de/1", "example.com/de/"),
        ("badexample.com", "/de/1", None), ("", "", None), ("", "", None), ("", "", None),
        ("É.example.org", "/Fr/1", None)]
    assert [r["verdict"] for r in got[:2]] == ["allow", "block"] and got[5]["verdict"] == "block"


def test_model_on_unseen_urls(spark):
    spam = ["http://online-casino.example.com/en/9", "http://cheap-meds-pills.example.org/es/3", "http://bets-free.example.com/en/1",
            "https://www.ads-track.example.com/en/55", "http://spam-farm.example.com/en/2", "http://adult-x.example.org/de/7"]
    good = ["http://ththou.example.org/en/3", "https://blog.therin.example.com/en/70", "http://www.ththea.example.org/de/1",
            "https://thernt.example.com/es/8.html"]
    got = [r["verdict"] for r in verdicts(spark, spam + good)]
    assert got == ["block"] * len(spam) + ["allow"] * len(good)


def test_training_equals_plain_gradient_steps(spark):
    """Brute force: the same features and steps with ordinary Python."""
    def slots(url):
        rest = url.split("://", 1)[1]
        host, _, path = rest.partition("/")
        path = "/" + path.split("?")[0].split("#")[0]
        out, digits = [], "".join("0" if c.isdigit() else c for c in path)
        while "00" in digits:
            digits = digits.replace("00", "0")
        for mark, text in (("h", f"^{host.lower()}$"), ("p", digits)):
            for n in U.GRAMS:
                for i in range(len(text) - n + 1):
                    value = xxhash.xxh64_intdigest(f"{mark}{n}:{text[i:i + n]}".encode(), 42)
                    out.append((value - (1 << 64) if value >= 1 << 63 else value) % U.SLOTS)
        return out

    rows = [(slots(u), y) for u, y in U.LABELLED]
    w, v = [0.0] * (U.SLOTS + 1), [0.0] * (U.SLOTS + 1)
    for _ in range(5):
        ahead = [a + U.MOMENTUM * b for a, b in zip(w, v)]
        g = [U.RIDGE * a for a in ahead]
        for s, y in rows:
            root = math.sqrt(len(s))
            error = 1 / (1 + math.exp(-(sum(ahead[k] for k in s) / root + ahead[-1]))) - y
            for k in s:
                g[k] += error / root / len(rows)
            g[-1] += error / len(rows)
        v = [U.MOMENTUM * b - U.RATE * d for b, d in zip(v, g)]
        w = [a + b for a, b in zip(w, v)]
    got = U.train(U.labelled_table(spark), steps=5)
    assert max(abs(a - b) for a, b in zip(got, w)) < 2e-6


def test_empty_tables_and_no_labels(spark):
    none = spark.createDataFrame([], "url string, label int")
    assert [r["verdict"] for r in verdicts(spark, ["http://free-bets.example.com/en/1"], none)] == ["allow"]
    assert U.judge(spark.createDataFrame([], PAGES), none).count() == 0
    odd = spark.createDataFrame([(1, "http://a.org/fr/", "h", "p", "r", 0.1)],
                                "page_id long, url string, host string, path string, rule string, probability double")
    assert U.judge(odd, none).first()["rule"] == "org/fr/"
