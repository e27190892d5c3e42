from basketwise.llm import url_reputation as u
from basketwise.llm.queries import URL_RULES, page_outcomes


def judged(spark, urls, outcomes):
    pages = spark.createDataFrame([(k, url, "clash") for k, url in enumerate(urls)], "page_id long, url string, host string")
    seen = spark.createDataFrame(outcomes, "host string, bad boolean")
    return {r["page_id"]: r for r in u.judge(pages, seen, URL_RULES).collect()}


def test_rules(spark):
    cases = [
        ("https://www.Example.com/en/1", "www.example.com", "/en/1", "www.example.com/en/", "allow"),
        ("http://a.www.example.com/en/", "a.www.example.com", "/en/", "www.example.com/en/", "allow"),
        ("http://x.example.com/en/?q=/a", "x.example.com", "/en/", "example.com/en/", "block"),
        ("http://x.example.com/fr/#t", "x.example.com", "/fr/", "com/", "allow"),
        ("http://example.com", "example.com", "", None, "allow"),
        ("http://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
        ("http://b.net/es/x://y", "b.net", "/es/x://y", "net/es/", "block"),
        ("ftp://net/fr/", "net", "/fr/", "net/fr/", "block"),
        ("b.net/es/", "", "", None, "allow"), (None, "", "", None, "allow"), ("", "", "", None, "allow"),
        ("http://É.NET/ES/", "É.net", "/ES/", None, "allow"), ("a://b?c://d/e", "b", "", None, "allow"),
    ]
    got = judged(spark, [c[0] for c in cases], [])
    for k, (_, host, path, rule, verdict) in enumerate(cases):
        assert (got[k]["host"], got[k]["path"], got[k]["rule"], got[k]["verdict"]) == (host, path, rule, verdict), cases[k]


def test_reputation_is_shrunk_and_bounded(spark):
    outcomes = [("bad.shop.org", True)] * 60 + [("good.shop.org", False)] * 300 + [("once.bazaar.org", True)]
    outcomes += [(f"h{n}.fine.co.uk", n % 10 == 0) for n in range(200)] + [("x.fine.co.uk", None)]
    hosts = ["bad.shop.org", "good.shop.org", "once.bazaar.org", "new.shop.org", "new.fine.co.uk", "unknown.info"]
    got = judged(spark, [f"http://{h}/" for h in hosts], outcomes)
    verdicts = {h: got[k]["verdict"] for k, h in enumerate(hosts)}
    # One bad page does not condemn a host, many do; others take the rate of those above them.
    assert verdicts == {h: "block" if h == "bad.shop.org" else "allow" for h in hosts}
    rate = {h: got[k]["bad_rate"] for k, h in enumerate(hosts)}
    assert rate["good.shop.org"] < rate["new.shop.org"] < rate["bad.shop.org"] and rate["once.bazaar.org"] < 1
    assert all(r["lower_bound"] <= r["bad_rate"] for r in got.values())


def test_empty_tables(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert u.judge(pages, spark.createDataFrame([], "host string, bad boolean"), URL_RULES).count() == 0


def test_every_form_of_url_yields_its_outcome(spark, tmp_path):
    forms = ["/en/{}", "/en/{}/", "/en/{}.html", "/en/{}#top", "/en/{}?page=2&ref=x", "/en/{}/?utm_source=feed", "/{}/"]
    other = ["/en/", "/en/x9/", "/en/9//", "/9/en/", "", "/"]
    urls = [f"http://h{n}.org" + form.format(n) for n, form in enumerate(forms)] + [f"http://none.org{path}" for path in other]
    pages = spark.createDataFrame([(n, url, "") for n, url in enumerate(urls)], "page_id long, url string, html string")
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    labels = spark.createDataFrame([(n, n % 2, 0) for n in range(10)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    got = {(r["host"], r["bad"]) for r in page_outcomes(spark, str(tmp_path)).collect()}
    assert got == {(f"h{n}.org", n % 2 == 0) for n in range(len(forms))}


def by_hand(host, rules):
    """Suffix and domain by the usual reading of the rules."""
    labels = host.split(".")
    best, exempt = 1, None
    for rule in rules:
        parts = rule.removeprefix("!").split(".")
        tail = labels[-len(parts) :]
        if len(labels) >= len(parts) and all(p in ("*", t) for p, t in zip(parts, tail, strict=True)):
            if rule[0] == "!":
                exempt = len(parts) - 1
            else:
                best = max(best, len(parts))
    n = best if exempt is None else exempt
    return ".".join(labels[-n:]), ".".join(labels[-n - 1 :])


def test_suffix_rules(spark):
    rules = ["com", "uk", "co.uk", "*.ck", "!www.ck", "com.cn", "*.kawasaki.jp", "!city.kawasaki.jp", "jp", "a.b.c.d", "*.x", "x"]
    hosts = ["", "com", "a.com", "b.a.com", "uk", "co.uk", "x.co.uk", "y.x.co.uk", "ck", "a.ck", "b.a.ck", "c.b.a.ck", "www.ck", "a.www.ck"]
    hosts += ["shop.com.cn", "m.shop.com.cn", "kawasaki.jp", "a.kawasaki.jp", "b.a.kawasaki.jp", "city.kawasaki.jp", "q.city.kawasaki.jp"]
    hosts += ["c.d", "a.b.c.d", "z.a.b.c.d", "x", "y.x", "z.y.x", "unknown.tld", "a..com", ".".join("n" * 20_000) + ".co.uk"]
    rows = [(r, 1) for r in [*rules, "CO.UK ", None, "", "com"]]
    table = spark.createDataFrame(rows, "rule string, tail int")
    frame = spark.createDataFrame([(h, 1) for h in [*hosts, "a.com"]], "host string, n int")
    got = u.with_domains(frame, table).collect()
    assert len(got) == len(hosts) + 1
    assert {r["host"]: (r["suffix"], r["domain"]) for r in got} == {h: by_hand(h, rules) for h in hosts}
    none = u.with_domains(frame, table.where("false")).collect()
    assert {r["host"]: (r["suffix"], r["domain"]) for r in none} == {h: by_hand(h, []) for h in hosts}


def test_domains_by_rules_keep_reputations_apart(spark):
    outcomes = [(f"h{n}.bad.com.cn", True) for n in range(80)] + [(f"h{n}.good.com.cn", False) for n in range(80)]
    pages = spark.createDataFrame([(0, "http://new.bad.com.cn/"), (1, "http://new.good.com.cn/")], "page_id long, url string")
    seen = spark.createDataFrame(outcomes, "host string, bad boolean")
    rules = spark.createDataFrame([("cn",), ("com.cn",)], "rule string")
    rate = lambda **kw: [r["bad_rate"] for r in u.judge(pages, seen, [], **kw).orderBy("page_id").collect()]
    apart, together = rate(suffixes=rules), rate()
    assert together[0] == together[1] and apart[0] > 0.9 and apart[1] < 0.1


def test_of_equally_long_rules_a_block_wins(spark):
    for rules in ([u.Rule("allow", "a.org", "/"), u.Rule("block", "a.org", "/")], [u.Rule("block", "a.org", "/"), u.Rule("allow", "a.org", "/")]):
        pages = spark.createDataFrame([(0, "http://a.org/x")], "page_id long, url string")
        row = u.judge(pages, spark.createDataFrame([], "host string, bad boolean"), rules).first()
        assert (row["rule"], row["verdict"]) == ("a.org/", "block")
