"""Registered queries over the driver's tables: SQL where there is any, else held-out rows or the tables' structure."""

import html
import re

import pytest
from pyspark.sql import functions as F

from tessella.llm import queries as Q
from tessella.llm import toxicity, urls
from tools_oracle import compare, connect

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_sql(spark, duck, name):
    ok, what = compare(spark, duck, name, Q.queries()[name], Q.oracle_sql()[name], SF)
    assert ok, what


def test_names():
    names = list(Q.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))


def table(spark, name, sf=SF):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def test_held_out_languages(spark):
    lang = {r.doc_id: r.lang for r in table(spark, "documents").select("doc_id", "lang").collect()}
    out = [r for r in Q.op2_language_id(spark, SF).collect() if r.held_out]
    assert len(out) > 100 and sum(r.lang_pred == lang[r.doc_id] for r in out) >= 0.98 * len(out)


def test_benchmark_passages(spark):
    docs = table(spark, "documents").select("doc_id", "text").collect()
    bench = table(spark, "benchmark").collect()
    whole = {(d.doc_id, b.item_id) for b in bench for d in docs if b.text in d.text}
    got = {(r.doc_id, r.item_id): r for r in Q.op1_decontamination(spark, SF).collect()}
    assert whole and whole <= got.keys()
    assert all(r.distance <= 0.09 * r.item_bytes for r in got.values())


def test_toxicity_of_documents_not_learnt_from(spark):
    larger = "/root/testdata/sf0.1"  # about 5 % of its toxic labels are on texts without any sign of it
    labels, docs = table(spark, "labels", larger), table(spark, "documents", larger)
    chain = toxicity.model(docs, labels.filter("doc_id % 5 <> 0"))
    toxic = {r.doc_id: r.toxic for r in labels.filter("doc_id % 5 = 0").collect()}
    flagged = {r.doc_id for r in toxicity.score(docs, chain).collect() if r.toxic} & toxic.keys()
    ones = {d for d, t in toxic.items() if t == 1}
    assert len(flagged & ones) >= 0.9 * len(ones)
    assert len(flagged & ones) >= 0.95 * len(flagged)


def test_articles(spark):
    for r in table(spark, "pages").join(Q.op9_html_extraction(spark, SF).drop("url"), "page_id").collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S).group(1)
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1|td|tr|table|li|ul)\b[^>]*>", inner)]
        assert r.text == "\n".join(p for p in parts if p)
        assert r.n_chars == len(r.text)


def test_verdicts_of_pages_not_learnt_from(spark):
    """Rules give the labels; one in nine pages under a rule falls under its exception, which hosts and words don't tell."""
    larger = "/root/testdata/sf0.1"
    got = urls.judge(table(spark, "pages", larger)).filter("rule IS NOT NULL").filter(urls.held_out(F.col("page_id"))).collect()
    says, is_ = [r.block_odds > 0 for r in got], [r.verdict == "block" for r in got]
    both = sum(a and b for a, b in zip(says, is_, strict=True))
    assert len(got) > 100 and both >= 0.85 * sum(says) and both >= 0.95 * sum(is_)
