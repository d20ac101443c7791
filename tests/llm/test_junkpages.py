import pytest

from memloom.llm import junkpages as jp

PROSE = ("The reviewer asked why the cache was moved before the release, and nobody could say whether it had been tested. "
         "We measured it again on Tuesday, because the first figures did not agree with those of the other team.")
JUNK = {
    "words": "cheap flights cheap hotels best cheap flights cheap hotels online cheap flights cheap deals best hotels cheap flights " * 3,
    "commas": ", ".join(["buy filter", "filter online", "cheap filter", "filter review", "best filter"] * 12),
    "lines": "\n".join(["download tracker", "lease allocator", "buffer thread premium", "top outline", "cheap manifest", "review quota"] * 5),
    "links": "\n".join(f"- [deal {i}](http://site{i}.example/{i})" for i in range(20)),
    "bare": "\n".join(f"http://a{i}.example/x/{i} b{i}.test/y" for i in range(20)),
    "html": "<ul>" + "".join(f'<li><a href="http://s{i}.example/">cheap tracker</a></li>\n' for i in range(15)) + "</ul>",
    "bbcode": "\n".join(f"[url=http://s{i}.example/]pro parser[/url]" for i in range(15)),
    "products": "\n".join(f"SKU ABC-{i:05} | draft vault | sturdy | {i}.50 EUR" for i in range(15)),
    "tags": "#CheapVault #BestDraft #VaultOnline #DraftDeal " * 8,
    "japanese": "激安 履歴 / 比較 履歴 / 通販 履歴 口コミ / 履歴 / " * 10,
    "hidden": "​".join("cheap vault online cheap vault buy cheap vault online cheap vault best cheap vault") * 2,
}
FINE = {
    "prose": PROSE,
    "table": "| name | owner | value |\n|---|---|---|\n" + "\n".join(f"| item{i} | team | {i} |" for i in range(30)),
    "code": "```\n" + "x = 1\n" * 40 + "```",
    "bare code": "\n".join(f"let value{i} = call({i}, \"x\");" for i in range(20)),
    "log": "\n".join(f"17427306{i:02} ERROR core.socket[12] mutex removed id=2ee took={i}" for i in range(30)),
    "checks": "\n".join(f"check core::case_{i} ... ok" for i in range(30)),
    "json": '[{"a": 1, "b": "x y"}, {"a": 2}]\n' * 10,
    "encoded": "CFosJ0U9o85A4IX4jC+F7xCyHtCccjVztyUPwoMLd30cXe6XqaydC0XMZjmJ6siNDDeQ" * 8,
    "german": "Seit gestern meldet der Schlüssel jeden entfernten Bestand, und niemand weiß, warum er nach sieben Läufen verworfen wird. " * 3,
    "russian": "Никто не понял, почему узел переносит отчёт, и нужно сохранить его ещё на пять дней. " * 4,
    "chinese": "系统移动了迟到的流程，第80个设置检查了。它拒绝了共享的信号，第569个流程更新了。" * 4,
    "short": "ok", "blank": "   \n\n ", "empty": "",
}


@pytest.mark.parametrize("name", JUNK)
def test_junk(name):
    assert jp.junk_share(JUNK[name]) > jp.SHARE


@pytest.mark.parametrize("name", FINE)
def test_fine(name):
    assert jp.junk_share(FINE[name]) <= jp.SHARE


def test_share_decides():
    assert jp.junk_share(JUNK["commas"] + "\n\n" + PROSE * 1) > jp.SHARE > jp.junk_share(JUNK["commas"] + "\n\n" + (PROSE + " ") * 8)


def test_recurrence():
    regular, lag, top = jp.recurrence(["a", "b", "c"] * 10)
    assert regular == 1 and lag == 1 and top == pytest.approx(2 / 3)
    assert jp.recurrence(["a"]) == (0.0, 0.0, 0.0) and jp.recurrence([f"w{i}" for i in range(50)])[:2] == (0, 0)


def test_operator(spark):
    rows = [(1, JUNK["lines"], 0.0), (1, JUNK["lines"], 0.0), (2, PROSE, 0.0), (3, None, 0.0), (4, "", 0.0), (None, JUNK["tags"], 0.0), (5, JUNK["words"] * 2000, 0.0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, junk_share double")
    assert sorted(str(r.doc_id) for r in jp.junk_pages(docs).collect()) == ["1", "1", "5", "None"]
    assert jp.junk_pages(docs.limit(0)).count() == 0


def test_agrees_with_reviews(spark):
    """Agreement with people's verdicts, some of which are wrong, on all reviewed documents."""
    from conftest import DATA

    d = DATA.replace("0.001", "0.1")
    shares = {r.doc_id: r.junk_share for r in jp.junk_shares(spark.read.parquet(f"{d}/documents.parquet")).collect()}
    votes = {}
    for r in spark.read.parquet(f"{d}/page_reviews.parquet").where("verdict in ('spam', 'ok')").collect():
        votes[r.doc_id] = votes.get(r.doc_id, 0) + (1 if r.verdict == "spam" else -1)
    agreed = [(v > 0) == (shares[i] > jp.SHARE) for i, v in votes.items() if v]
    assert sum(agreed) / len(agreed) > 0.9


def test_short_pages_and_unknown_scripts():
    assert jp.junk_share("buy filter cheap filter best tool") > jp.SHARE and jp.junk_share("हिन्दी पाठ ३ बार") == 0


def test_long_periods_and_repeated_clauses():
    words = [f"term{i}" for i in range(40)] + ["of", "the"]
    regular, lag, _ = jp.recurrence(words * 8)
    assert regular > 0.9 and lag == 1
    clauses = "系统移动了迟到的流程，" * 40
    assert jp.junk_share(clauses) > jp.SHARE


def test_lists_by_gaps():
    assert jp.listed(["a", "b", jp.LINK] * 5, 10) and not jp.listed(["a"] * 40 + [jp.LINK], 200) and not jp.listed(["a"], 1)


def test_recurrence_decides(spark, monkeypatch):
    """Without the analysis of recurrence less than half of the pages are found."""
    from conftest import DATA

    texts = [r.text for r in spark.read.parquet(f"{DATA.replace('0.001', '0.01')}/documents.parquet").select("text").collect()]
    found = sum(jp.junk_share(t) > jp.SHARE for t in texts)
    monkeypatch.setattr(jp, "recurrence", lambda terms: (0.0, 0.0, 0.0))
    monkeypatch.setattr(jp, "listed", lambda terms, chars: False)
    assert sum(jp.junk_share(t) > jp.SHARE for t in texts) < found / 2
