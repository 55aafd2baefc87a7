import datetime as dt
import random

from granary.llm import urlfilter

ENTRIES = "domain string, action string, dated date"


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(n)


def plain(host, when, entries):
    labels = host.split(".")
    for i in range(len(labels)):
        suffix = ".".join(labels[i:])
        past = [(d, ["block", "allow", "remove"].index(a), a) for s, a, d in entries if s == suffix and d <= when]
        if past:
            latest = max(p[0] for p in past)
            action = min(p[1:] for p in past if p[0] == latest)[1]
            if action != "remove":
                return action, suffix
    return "none", None


def test_verdicts_match_brute_force(spark):
    rng = random.Random(1)
    names = ["a.b.example.com", "b.example.com", "example.com", "c.net", "x.c.net", "d.org"]
    entries = [(rng.choice(names), rng.choice(["block", "allow", "remove"]), day(rng.randrange(300))) for _ in range(60)]
    pages = [(i, f"HTTPS://u@{rng.choice(names).upper()}.:80/p?q", day(rng.randrange(-50, 400))) for i in range(400)]
    got = urlfilter.judge(spark.createDataFrame(pages, "page_id long, url string, fetched_on date"), spark.createDataFrame(entries, ENTRIES)).collect()
    assert len(got) == 400
    for r in got:
        assert (r["verdict"], r["domain"]) == plain(r["host"], r["fetched_on"], entries)


def test_addresses_have_no_suffixes(spark):
    urls = ["http://[2001:DB8::1]:80/a", "http://u@10.1.2.3:8080/", "https://1.2.3/", "http://[::1", "http://2.3/"]
    df = spark.createDataFrame([(i, u, day(3)) for i, u in enumerate(urls)], "page_id long, url string, fetched_on date")
    entries = spark.createDataFrame([(d, "block", day(0)) for d in ("[2001:db8::1]", "2.3", "3", "10.1.2.3")], ENTRIES)
    got = {r["id"]: (r["host"], r["verdict"], r["domain"]) for r in urlfilter.judge(df, entries).collect()}
    assert got == {0: ("[2001:db8::1]", "block", "[2001:db8::1]"), 1: ("10.1.2.3", "block", "10.1.2.3"), 2: ("1.2.3", "block", "2.3"), 3: (None, "unknown", None), 4: ("2.3", "block", "2.3")}


def test_intervals_end_with_the_next_entry(spark):
    rows = [("A.com ", "block", day(0)), ("a.com", "allow", day(5)), ("a.com", "block", day(5)), ("a.com", "remove", day(9)), (None, "block", day(1)), ("b.com", None, day(1)), ("c.com", "odd", day(1)), ("d.com", "block", None)]
    got = urlfilter.validity(spark.createDataFrame(rows, ENTRIES)).collect()
    assert sorted(tuple(r) for r in got) == [("a.com", "block", day(0), day(5)), ("a.com", "block", day(5), day(9))]


def test_awkward_rows(spark):
    pages = [(1, None, day(1), "c"), (2, "no url", day(1), "c"), (3, "http://a.com/x", None, "c"), (None, "http://a.com", day(1), None), (4, "http://a.com", day(1), "c"), (4, "http://a.com", day(1), "c"), (5, "http:///x", day(1), "c"), (6, "http://" + "a." * 500 + "com", day(2), "c")]
    df = spark.createDataFrame(pages, "page_id long, url string, fetched_on date, domain string")
    entries = spark.createDataFrame([("a.com", "block", day(0))], ENTRIES)
    got = sorted((str(r["id"]), r["verdict"]) for r in urlfilter.judge(df, entries).collect())
    assert got == [("1", "unknown"), ("2", "unknown"), ("3", "unknown"), ("4", "block"), ("4", "block"), ("5", "unknown"), ("6", "block"), ("None", "block")]
    assert {r["verdict"] for r in urlfilter.judge(df, entries.limit(0)).collect()} == {"unknown", "none"}
    assert urlfilter.judge(df.limit(0), entries).collect() == []
