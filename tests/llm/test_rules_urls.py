import random
import re

from pyspark.sql import functions as F

from scrubline.llm import quality_rules, url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen, hit = {}, set()
    for k in range(len(w) - 2):
        seen.setdefault(tuple(w[k : k + 3]), []).append(k)
    for at in seen.values():
        if len(at) > 1:
            hit.update(k + d for k in at for d in range(3))
    failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), failed)


def test_base_measures_equal_brute_force(spark):
    r = random.Random(4)
    texts = [None, "", " \n\t ", "a", "a b", "a b c", "a b c a b c", "x x x x x", "é😀 # é😀 #\né😀 #\n\x0bé😀 #",
             "\u00a0 \u2003 one\u00a0word", " lead and trail ", "same\nsame\n same\nsame", "w " * 3000]
    texts += [" ".join(r.choice("ab cd ef g\nh #x".split(" ")) for _ in range(r.randrange(150))) for _ in range(60)]
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)] + [(None, "a b c", "y")], "doc_id long, text string, n_words string")
    got = {r["doc_id"]: r for r in quality_rules.judged(df).collect()}
    for k, t in enumerate(texts):
        g = got[k]
        assert tuple(g[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == base(t), t
    assert len(got) == len(texts) + 1
    assert quality_rules.judged(df.limit(0)).count() == 0


def test_verdicts(spark):
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    clean = " ".join(word() if k % 4 else r.choice(["the", "Der,", "les", "que"]) for k in range(90))
    texts = {
        "clean": clean, "symbols": re.sub(" ", "### ", clean), "shouted": re.sub(" ", "!! ", clean.upper()),
        "no_stop": " ".join(word() for _ in range(90)), "bullets": "\n".join("- " + clean for _ in range(1)),
    }
    got = {x["doc_id"]: x for x in quality_rules.judged(spark.createDataFrame(list(texts.items()), "doc_id string, text string")).collect()}
    assert got["clean"]["kept"] and not got["clean"]["failed"]
    assert got["symbols"]["failed"] == ["symbols"] and got["shouted"]["failed"] == ["exclamations"]
    assert got["no_stop"]["failed"] == ["stop_words"] and got["bullets"]["failed"] == ["bullets"]
    assert not any(got[k]["kept"] for k in texts if k != "clean")


def test_rules_are_one_projection_without_python(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = quality_rules.judged(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def verdict(url, rules):
    host, path = "", ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = []
    for rule, v in rules:
        h, p = re.match(r"([^/]*)(.*)", rule).groups()
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            fits.append((len(rule), rule, v))
    return (host, path, max(fits)[1], max(fits)[2]) if fits else (host, path, None, "allow")


RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]
URLS = [
    None, "", "no scheme.com/", "http://", "http://com", "http://com/", "HTTP://WWW.Example.COM/en/x?q#f", "https://a.example.com/en/",
    "http://example.com/en", "http://badexample.com/en/", "x://m.net/es/a://b", "ftp://net/fr/?", "http://É.NET/fr/é", "http://a.net#/es/",
    "http://a..com//en/", "http://user@a.net:80/es/", "http://a.net/es/\nnew",
]


def test_verdicts_of_urls_equal_brute_force(spark):
    rows = [(k, u, "x") for k, u in enumerate(URLS * 2)] + [(None, "http://a.com/", "y")]
    df = spark.createDataFrame(rows, "page_id long, url string, verdict string")
    r = random.Random(2)
    many = RULES + [(f"h{r.randrange(400)}.org/{'p' * r.randrange(6)}", "block") for _ in range(600)]
    many = list(dict(many).items())
    for rules in (RULES, many, []):
        listed = url_filter.rules_of(spark, rules + [(None, "block"), ("/x", "block"), ("z.com/", "odd")])
        got = url_filter.judged(df, listed)
        want = [(i, *verdict(u, rules)) for i, u, _ in rows]
        assert sorted([tuple(x[c] for c in ("page_id", "host", "path", "rule", "verdict")) for x in got.collect()], key=repr) == sorted(want, key=repr)


def test_long_hosts_long_lists_and_many_copies(spark, monkeypatch):
    long_host = "x." * 50_000 + "example.com"
    urls = [f"http://{long_host}/en/a", "http://a.b.c.d.e/" + "p" * 100_000, "http://www.example.com/en/y"]
    rows = list(enumerate(urls)) + [(10 + k, "http://hot.example.com/en/z") for k in range(900)] + [(2000 + k, "http://no.rule/") for k in range(900)]
    rules = RULES + [(f"r.org/{'p' * k}", "block") for k in range(2000)] + [(f"{'l.' * k}z", "block") for k in range(300)] + [("d.e/" + "p" * 1500, "block")]
    df = spark.createDataFrame(rows, "page_id long, url string").repartition(6)
    got = url_filter.judged(df, url_filter.rules_of(spark, rules))
    want = {i: verdict(u, rules) for i, u in rows[:3] + rows[3:4] + rows[-1:]}
    found = got.collect()
    assert len(found) == len(rows)
    for r in found:
        key = r["page_id"] if r["page_id"] < 10 else 10 if r["page_id"] < 2000 else rows[-1][0]
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == want[key]


def test_filter_passes_every_listed_key(spark):
    keys = spark.range(3000).select(F.concat(F.lit("h"), "id", F.lit(".org")).alias("h"), F.lit("/").alias("p"))
    masks = keys.select(url_filter._filter_key(F.col("h"), F.col("p"), 64))
    row = masks.groupBy("block").agg(*[F.bit_or(f"m{w}").alias(f"m{w}") for w in range(url_filter.WORDS)])
    assert row.count() == 64
    other = keys.select(F.concat(F.lit("q"), "h").alias("h"), "p").select(url_filter._filter_key(F.col("h"), F.col("p"), 4096))
    small = keys.limit(2000).select(url_filter._filter_key(F.col("h"), F.col("p"), 4096)).groupBy("block").agg(
        *[F.bit_or(f"m{w}").alias(f"f{w}") for w in range(url_filter.WORDS)])
    false = other.join(small, "block").where(" and ".join(f"(f{w} & m{w}) = m{w}" for w in range(url_filter.WORDS))).count()
    assert false < 60
