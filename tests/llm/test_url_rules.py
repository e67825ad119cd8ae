import re
import string

import pytest

from scribelake.llm import url_rules
from scribelake.llm.queries import RULES

URLS = [
    "http://a.com/", "http://com", "https://COM/x", "http://www.example.com/en/1?q#f", "http://example.com/en/",
    "http://xexample.com/en/a", "http://b.example.com/en/a", "http://example.com/en", "http://x.net/es/1",
    "http://net/fr/", "http://xnet/fr/", "http://u:p@x.net:80/es/", "mailto:a@b.com", "", None, "://", "a://b://c/",
    "http://x.org/a\nb", "http://x.org?/en/", "http://x.org#x/en/", "HTTP://WWW.Example.COM/EN/", "http://É.com/",
]

MORE = (*RULES, ("block", "", "/private"), ("allow", "org", ""), ("block", "x.org", "/*/b/*.pdf"), ("allow", "x.org", "/a/b/"))


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3 :]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return host.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)), path


def judge(host, path, rules, default="allow"):
    best = None
    for verdict, h, p in rules:
        if not (h == "" or host == h or host.endswith("." + h)):
            continue
        if p == "" and not (path == "" or path.startswith("/")):
            continue
        if not re.match(".*".join(map(re.escape, p.split("*"))), path, re.S):
            continue
        key = (-len(h + p), -len(h), verdict != "block", h + p, verdict)
        best = key if best is None else min(best, key)
    return (None, default) if best is None else best[3:]


@pytest.mark.parametrize("rules", [RULES, MORE, ()])
def test_equals_trying_every_rule(spark, rules):
    urls = URLS * 2 + ["http://x.org/a/b/c.pdf", "http://y.com/private/x", "http://x.org/a/b/", "http://x.org"]
    pages = spark.createDataFrame([(k, u, "h", "r") for k, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    rows = url_rules.judge_urls(pages, url_rules.rule_table(spark, rules)).collect()
    assert len(rows) == len(urls)
    for r in rows:
        host, path = parts(urls[r.page_id])
        assert (r.host, r.path) == (host, path)
        assert (r.rule, r.verdict) == judge(host, path, rules)


def test_the_rarest_token_files_a_rule(spark):
    assert url_rules._literals("www.example.com", "/en/x") == ["h:www", "h:example", "h:com", "p:en"]
    assert url_rules._literals("", "/private") == []
    with pytest.raises(ValueError, match="verdict"):
        url_rules.rule_table(spark, [("maybe", "com", "/")])


def test_repeats_nulls_and_empty_tables(spark):
    rules = url_rules.rule_table(spark, RULES)
    schema = "page_id long, url string"
    pages = spark.createDataFrame([(None, None), (None, None), (1, "http://a.com/"), (1, "http://a.com/")], schema)
    rows = url_rules.judge_urls(pages, rules, default="block").collect()
    assert sorted(r.verdict for r in rows) == ["allow", "allow", "block", "block"]
    assert url_rules.judge_urls(spark.createDataFrame([], schema), rules).count() == 0
