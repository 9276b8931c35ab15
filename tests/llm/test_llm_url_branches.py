"""Pages without a rule are judged by siblings at any level, else by the nearest labelled branch above."""

from millrace.llm import urls


def test_unlabelled_templates_inherit(spark):
    given = {
        **{i: f"http://s.net/{'abcdef'[i % 6]}/list/x{i % 3}" for i in range(30)},  # bad by rule
        100: "http://s.net/g/list/x1",  # siblings in the first segment
        101: "http://s.net/a/list/new",  # siblings in the last one
        102: "http://s.net/a/other/deep/er",  # the branch /a above
        103: "http://s.net/q",  # nothing but the host
        104: "http://s.net",
        **{200 + i: f"http://t.net/good/{'pq'[i % 2]}{i % 5}" for i in range(20)},  # good by rule
        300: "http://t.net/good/else/where",
        301: "http://u.net/a/list/x1",  # a host without labels
    }
    rules = urls.parse_rules(*[f"block s.net/{c}/list/x" for c in "abcdef"], "allow t.net/good/p", "allow t.net/good/q")
    got = {r["page_id"]: r for r in urls.filter_urls(spark.createDataFrame(list(given.items()), "page_id long, url string"), rules).collect()}
    assert len(got) == len(given) and all(got[i]["rule"] is None for i in (100, 101, 102, 103, 104, 300, 301))
    assert {i: got[i]["verdict"] for i in (100, 101, 102, 103, 104, 300, 301)} == {100: "block", 101: "block", 102: "block", 103: "block", 104: "block", 300: "allow", 301: "allow"}
    assert got[301]["bad_share"] == 0.25 and got[300]["bad_share"] < 0.25


def test_near_branches_come_before_far_ones(spark):
    given = {**{i: f"http://h.net/x/bad/{'rst'[i % 3]}" for i in range(30)}, **{100 + i: f"http://h.net/y/good/{'rst'[i % 3]}" for i in range(30)}, 200: "http://h.net/x/bad/u", 201: "http://h.net/y/good/u", 202: "http://h.net/x/else", 203: "http://h.net/y/else"}
    rules = urls.parse_rules(*[f"block h.net/x/bad/{c}" for c in "rst"], *[f"allow h.net/y/good/{c}" for c in "rst"])
    got = {r["page_id"]: r["verdict"] for r in urls.filter_urls(spark.createDataFrame(list(given.items()), "page_id long, url string"), rules).collect()}
    assert {k: v for k, v in got.items() if k >= 200} == {200: "block", 201: "allow", 202: "block", 203: "allow"}


def test_a_branch_holds_its_own_pages(spark):
    given = {**{i: "http://h.net/x" for i in range(20)}, 50: "http://h.net/x/a/b", 51: "http://h.net"}
    got = {r["page_id"]: r["verdict"] for r in urls.filter_urls(spark.createDataFrame([(1000 + i, "http://h.net/x?") for i in range(20)] + list(given.items()), "page_id long, url string"), [urls.Rule("block", "h.net", "/x")]).collect()}
    assert got[51] == "block"
    allowed = urls.filter_urls(spark.createDataFrame([(i, "http://h.net/x/y") for i in range(20)] + [(50, "http://h.net/x"), (51, "http://h.net/x/z/u/v")], "page_id long, url string"), [urls.Rule("block", "h.net", "/x/y")])
    assert {r["verdict"] for r in allowed.collect()} == {"block"}
