"""Perspectives and URL reputation: small cases beside the comparison with SQL."""

from __future__ import annotations

import random
import re
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.llm import chat, queries, url_reputation

TURNS = "conv_id long, turn long, role string, text string, speaker string, segment int, rank int"


def turns(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 1) for r in rows], TURNS)


def test_every_participant_has_a_view(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", "<|im_start|>"), (1, 3, "ann", None), (2, None, None, "?"), (3, 0, "system", "alone"), (None, 1, "ann", "x"), (1, 1, "ann", "hi")]
    got = {(r["conv_id"], r["speaker"]): r for r in chat.perspectives(turns(spark, rows)).collect()}
    assert set(got) == {(1, "ann"), (1, "bob"), (2, "unknown"), (None, "ann")}
    ann = got[1, "ann"]
    assert ann["text"] == "<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>assistant\nhi<|im_end|>\n<|im_start|>assistant\nhi<|im_end|>\n<|im_start|>user name=bob\n< |im_start|><|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    assert [ann["text"][m["start"] : m["stop"]] for m in ann["masks"]] == ["hi<|im_end|>", "hi<|im_end|>", "<|im_end|>"]
    bob = got[1, "bob"]
    assert "user name=ann\nhi" in bob["text"] and [bob["text"][m["start"] : m["stop"]] for m in bob["masks"]] == ["< |im_start|><|im_end|>"]
    assert chat.perspectives(turns(spark, [])).count() == 0


def test_long_dialogues_are_cut_into_segments(spark):
    rows = [(1, i, "ann" if i % 2 else "bob", f"t{i}") for i in range(300)] + [(i, 0, "ann", "x") for i in range(2, 50)]
    got = chat.perspectives(turns(spark, rows)).where("conv_id = 1 and speaker = 'ann'").orderBy("segment").collect()
    assert [r["n_turns"] for r in got] == [64, 64, 64, 64, 44]
    text = "".join(r["text"] for r in got)
    assert [p.split("<")[0] for p in text.split("\n") if p.startswith("t")] == [f"t{i}" for i in range(300)]


def test_turns_with_one_number_go_as_in_sql(spark, tmp_path):
    """Ties, nulls, repeated turns, names with line ends and a very long text, against the query's SQL."""
    rows = [(1, 0, "ann", x) for x in "abcdefgh"] + [(1, 0, "ann", "a"), (1, None, None, None), (1, 1, "b\nob\r", "x"), (1, 1, "unknown", "x" * 300_000), (2, 0, "ann", "hi")] + [(3, 5, "ann", "same")] * 130
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.op6_chat_perspectives(spark, str(tmp_path)).toPandas()
    want = duckdb.sql(queries.chat.oracle(f"'{tmp_path}/conversations.parquet/*.parquet'")).df()
    key = lambda t: sorted(map(tuple, t[sorted(t.columns)].astype(str).values.tolist()))
    assert key(got) == key(want)


URLS = [
    ("http://A.B.example.net/en/x?q#f", "a.b.example.net", "/en/x"), ("https://h.org", "h.org", ""), ("x://h?a://b/", "h", ""), ("no-scheme.net/en/", "", ""), (None, "", ""), ("", "", ""),
    ("http://\u00c4.net/\n/p#x", "\u00c4.net", "/\n/p"), ("http://u:p@h.net:80/", "u:p@h.net:80", "/"),
]


@pytest.mark.parametrize("url,host,path", URLS)
def test_host_and_path(spark, url, host, path):
    row = spark.createDataFrame([(url,)], "u string").select(url_reputation.host_of(F.col("u")), url_reputation.path_of(F.col("u"))).first()
    assert tuple(row) == (host, path)


def test_longest_rule_wins(spark):
    from tidemark.llm.queries import RULES

    cases = [("net", "/x", "net/"), ("a.net", "/", "net/"), ("a.net", "", None), ("anet", "/", None), ("www.example.net", "/en/a", "example.net/en/"), ("example.net", "/en", "net/"), ("q.example.com", "/de/", "example.com/de/"), ("x.org", "/fr/1", "org/fr/"), ("", "", None)]
    df = spark.createDataFrame([(h, p, w) for h, p, w in cases], "h string, p string, w string")
    assert df.where(~url_reputation.rule_for(F.col("h"), F.col("p"), RULES)[0].eqNullSafe(F.col("w"))).count() == 0


def test_reputation_shrinks(spark):
    """A bad host is blocked on much evidence, not on one page; a new host goes by its domain."""
    rows = [("bad.example.com", 0)] * 60 + [("good.example.com", 1)] * 200 + [("one.example.com", 0)] + [("a.rotten.org", 0)] * 80 + [("b.rotten.org", 0)] * 80 + [("new.rotten.org", None)] + [("fine.org", 1)] * 100
    df = spark.createDataFrame(rows, "host string, outcome long")
    got = {r["host"]: r for r in url_reputation.reputation(df).collect()}
    blocked = {h for h, r in got.items() if r["upper"] < 0.5}
    assert {"bad.example.com", "a.rotten.org", "b.rotten.org"} <= blocked and not {"one.example.com", "good.example.com", "fine.org"} & blocked
    assert got["new.rotten.org"]["mean"] < got["one.example.com"]["mean"]
    assert {r["upper"] for r in url_reputation.reputation(df.withColumn("outcome", F.lit(None).cast("long"))).collect()} == {1.0}


DOMAINS = [("a.b.example.co.uk", "example.co.uk", "co.uk"), ("co.uk", "co.uk", "co.uk"), ("u@h.example.com:80", "example.com", "com"), ("1.2.3.4:8", "1.2.3.4", "1.2.3.4"), ("[::1]", "[::1]", "[::1]"), ("localhost", "localhost", "localhost"), ("", "", "")]


@pytest.mark.parametrize("host,domain,suffix", DOMAINS)
def test_registered_domains(spark, host, domain, suffix):
    own = url_reputation.domain_of(F.col("h"))
    assert tuple(spark.createDataFrame([(host,)], "h string").select(own, url_reputation.suffix_of(own)).first()) == (domain, suffix)


def planted_pages(spark):
    prose = "<html><body><nav><a href='/x'>home</a></nav><p>" + "some plain words of a page " * 20 + "</p></body></html>"
    bad = ["<p>" + "buy | now $$$ " * 60 + "</p>", "<p>" + "WIN MONEY TODAY " * 60 + "</p>", "".join(f"<a href='/{i}'>some link here</a> " for i in range(60)), "<script>" + "x " * 500 + "</script><p>short</p>"]
    rows = [(f"http://www{i % 7}.fine{i % 5}.com/{i}", prose if i % 12 else bad[i % 4]) for i in range(1400)]
    rows += [(f"http://casino{i % 3}.example.com/{i}", bad[i % 4]) for i in range(150)]
    rows += [(f"http://a.spam.co.uk/{i}", bad[i % 4]) for i in range(80)] + [(f"http://b.good.co.uk/{i}", prose) for i in range(80)] + [("http://new.spam.co.uk/", None), ("http://1.2.3.4/", prose), (None, prose), ("x", None)]
    rows += [(f"http://casino0.example.com/de/{i}", prose) for i in range(2)] + [("http://casino1.net/fr", bad[0])] + [("http://long.org/", "word " * 200_000)]
    return spark.createDataFrame([(i, u, h, "x") for i, (u, h) in enumerate(rows)], "page_id long, url string, html string, host string")


def test_reputation_blocks_bad_hosts_as_in_sql(spark, tmp_path):
    planted_pages(spark).repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    got = queries.op8_url_reputation(spark, str(tmp_path)).toPandas()
    want = duckdb.sql(url_reputation.oracle(f"'{tmp_path}/pages.parquet/*.parquet'", queries.RULES)).df()
    key = lambda t: sorted(map(tuple, t[["page_id", "host", "path", "rule", "verdict"]].astype(object).where(t.notna(), None).astype(str).values.tolist()))
    assert key(got) == key(want)
    blocked = got[got["rule"].isna() & (got["verdict"] == "block")]
    assert set(blocked["host"]) == {"casino0.example.com", "casino1.example.com", "casino2.example.com", "a.spam.co.uk", "new.spam.co.uk"}


def test_tags_go_as_by_the_plain_patterns(spark):
    """Random pages of beginnings and ends, in any case and order: what the patterns give without a bound of time."""
    rng = random.Random(8)
    parts = ["<script", "</script>", "<SCRIPT>", "</Script>", "<style ", "</style>", "<!--", "-->", "<!-->", "<a", "<a ", "<A x>", "</a>", "</A>", "<", ">", "text ", "\n", "<scripts>", " é", "<b>", "x", "<abc>"]
    pages = ["", *("".join(rng.choice(parts) for _ in range(rng.randint(1, 14))) for _ in range(3000))]
    plain = lambda html: re.sub(url_reputation._TAGS, " ", html, flags=re.ASCII)
    frame = spark.createDataFrame([(h,) for h in pages], "html string")
    got = frame.select("html", url_reputation.without_tags(F.col("html")).alias("text"), url_reputation.link_text(F.col("html")).alias("linked")).collect()
    for r in got:
        assert r["text"] == plain(r["html"]), r["html"]
        want = " ".join(re.findall(url_reputation._LINK, r["html"], flags=re.ASCII))
        assert len(r["linked"]) == len(want) and len(plain(r["linked"])) == len(plain(want))


@pytest.mark.parametrize("piece", ["<script ", "<style>", "<!--", "<a ", "<", "<a </a>", "<a x><script>", ">", "</a>", "<a><a"])
def test_hostile_pages_take_linear_time(spark, piece):
    """10 MB each; one of 64,000 characters took 42 s before."""
    page = piece * (10_000_000 // len(piece))
    frame = spark.createDataFrame([("http://" + "a" * 200_000 + "/x", page)], "url string, html string")
    began = time.perf_counter()
    row = frame.select(url_reputation.good_page(F.col("html")).alias("good"), F.length(url_reputation.domain_of(url_reputation.host_of(F.col("url")))).alias("n")).first()
    assert row["good"] == 0 and row["n"] == 200_000
    assert time.perf_counter() - began < 20


def test_judge_edge_cases(spark):
    pages = spark.createDataFrame([(1, None, None, "x"), (1, "http://h.com/", "<p>t</p>", "x"), (None, "http://h.com/", None, "x"), (4, "", "", "x")], "page_id long, url string, html string, host string")
    got = url_reputation.judge(pages, url_reputation.good_page(F.col("html")), ())
    assert got.count() == 4 and {r["verdict"] for r in got.collect()} == {"allow"}
    assert url_reputation.judge(pages.limit(0), url_reputation.good_page(F.col("html")), ()).count() == 0
