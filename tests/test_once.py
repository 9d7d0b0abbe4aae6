"""Inputs that a query reads several times are worked out once."""

import csv
import random

from conftest import SF_SMALL

from duebook.plans import queries
from duebook.sources import statements


def worked_out(df):
    """Does reading `df` run expressions on the lines again?"""
    return "regexp_replace" in df._jdf.queryExecution().optimizedPlan().toString()


def test_resolution_scrubs_each_line_once(spark):
    assert not worked_out(queries.resolution_state(
        spark, SF_SMALL, queries.views.event_lines).transactions)


def sniffed(text):
    end = text.rfind("\n", 0, statements.SNIFF_CHARS) + 1 or text.find("\n") + 1 or len(text)
    try:
        return csv.Sniffer().sniff(text[:end], delimiters=statements.DELIMITERS)
    except csv.Error:
        return csv.excel


def test_separator_is_what_the_sniffer_finds(monkeypatch):
    rng = random.Random(3)
    texts = ["", "\n\n", "a", "a;b,c\n"]
    for _ in range(3000):
        mark = rng.choice(",;\t|") + rng.choice(["", " "])
        texts.append("\n".join(mark.join(
            "".join(rng.choice("ab1,.;| ") for _ in range(rng.randrange(3)))
            for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(45))))
    want = [sniffed(t) for t in texts]
    monkeypatch.setattr(csv, "Sniffer", None)       # no text without quotes needs it
    for text, a in zip(texts, want):
        b = statements.dialect_of(text)
        assert (a.delimiter, a.quotechar, bool(a.doublequote), bool(a.skipinitialspace)) == (
            b.delimiter, b.quotechar, bool(b.doublequote), bool(b.skipinitialspace)), text


def test_named_reports_scrub_each_line_once(spark, monkeypatch):
    seen, real = [], queries.reports.call_for_all
    monkeypatch.setattr(queries.reports, "call_for_all", lambda tables, *more: seen.append(
        tables["raw_transaction"]) or real(tables, *more))
    queries.named_reports(spark, SF_SMALL)
    assert len(seen) == 6 and not any(worked_out(df) for df in seen)


def test_load_report_parses_each_line_once(spark, monkeypatch):
    seen, real = [], statements.file_facts
    monkeypatch.setattr(statements, "file_facts", lambda typed: seen.append(typed) or real(typed))
    assert queries.load_report(spark, SF_SMALL).count()
    assert len(seen) == 1 and not worked_out(seen[0])
