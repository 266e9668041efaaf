"""News ranking (NEWS-1..5, NEWS-U, NEWS-D).

Scale notes
* Keep-first dedupe is an aggregation, not a window: ``min(struct(feed_pos,
  item_pos, ...))`` per title key is partially aggregated map-side, so a title
  repeated across a third of all items still leaves each map task as one row.
* Ranking is ``orderBy(...).limit(n)``, planned as TakeOrderedAndProject: every
  task keeps its own top n and only those are merged.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from episcope.functions.dates import normalize_date, sort_instant
from episcope.functions.text import collapse_ws, with_clean_summary

# --- fixed values: the default relevance terms, in order ---
RELEVANCE_TERMS = (
    "srag", "síndrome respiratória", "sindrome respiratoria", "infogripe", "gripe",
    "influenza", "covid", "sars-cov", "vsr", "vírus sincicial", "respiratór", "vacina",
    "imuniza", "sivep", "vigilância epidemiológica", "surto", "internaç", "uti",
)
# --- fixed values: title prefixes of navigation items ---
JUNK_TITLE_PREFIXES = ("nav.", "navegação", "menu")


def is_navigation(title: Column) -> Column:
    """NEWS-3: empty titles and titles starting with a navigation prefix."""
    t = F.lower(title)
    starts = None
    for p in JUNK_TITLE_PREFIXES:
        hit = t.startswith(p)
        starts = hit if starts is None else starts | hit
    return title.isNull() | (title == "") | starts


def drop_navigation(items: DataFrame, title: str = "title") -> DataFrame:
    return items.where(~is_navigation(F.col(title)))


def relevance_score(title: Column, summary: Column, terms: Sequence[str] = RELEVANCE_TERMS) -> Column:
    """NEWS-4: number of terms contained (as substrings) in lower(title + ' ' + summary)."""
    hay = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(summary, F.lit(""))))
    score = F.lit(0)
    for term in terms:
        score = score + hay.contains(term.lower()).cast("int")
    return score


def title_key(title: Column) -> Column:
    """Dedupe key: lower case, whitespace collapsed, trimmed."""
    return collapse_ws(F.lower(title))


def prepare_items(raw: DataFrame) -> DataFrame:
    """Raw feed items → cleaned items: summary text, ISO date and sort instant.

    Input columns: feed_pos, item_pos, source, title, description, url and either
    ``raw_date`` (text) or ``instant`` (timestamp).
    """
    if "raw_date" in raw.columns:
        date = F.coalesce(normalize_date(F.col("raw_date")), F.lit(""))
        instant = sort_instant(F.col("raw_date"))
    else:
        date = F.coalesce(F.date_format("instant", "yyyy-MM-dd"), F.lit(""))
        instant = F.col("instant")
    items = with_clean_summary(drop_navigation(raw), "description", "summary")
    return items.select(
        "feed_pos", "item_pos", "source", "title", "summary",
        date.alias("date"), F.coalesce(F.col("url"), F.lit("")).alias("url"),
        instant.alias("instant"))


def union_feeds(*feeds: DataFrame) -> DataFrame:
    """NEWS-U: concatenate feeds in registry order (``feed_pos`` carries the order)."""
    out = feeds[0]
    for f in feeds[1:]:
        out = out.unionByName(f)
    return out


def dedupe_titles(items: DataFrame) -> DataFrame:
    """NEWS-D: keep the first item (by feed_pos, item_pos) of each normalised title."""
    rest = [c for c in items.columns if c not in ("feed_pos", "item_pos")]
    first = F.min(F.struct("feed_pos", "item_pos", *rest)).alias("first")
    return (items.groupBy(title_key(F.col("title")).alias("_key")).agg(first)
            .select("first.*"))


def rank_news(items: DataFrame, max_results: int = 5,
              terms: Sequence[str] = RELEVANCE_TERMS) -> DataFrame:
    """NEWS-5: dedupe → sort (score desc, instant desc, then source order) → first n.

    The source's sort is stable, so ties keep feed/item order; ``rank`` numbers
    the kept rows (a window over at most ``max_results`` rows).
    """
    if max_results < 1:
        raise ValueError("max_results must be positive")
    order = [F.col("score").desc(), F.col("instant").desc_nulls_last(),
             F.col("feed_pos").asc(), F.col("item_pos").asc()]
    scored = dedupe_titles(items).withColumn(
        "score", relevance_score(F.col("title"), F.col("summary"), terms))
    top = scored.orderBy(*order).limit(max_results)
    return (top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
            .drop("instant"))


def ranked_news_text(ranked: DataFrame) -> Column:
    """Ranked items rendered as the report's news block, as one scalar string.

    Rendering happens inside the (bounded) aggregate, so the report side only
    concatenates a string; an empty ranking gives the no-news line.
    """
    from episcope.operators.report import news_block
    entries = F.array_sort(F.collect_list(F.struct("rank", "title", "source", "date", "summary")))
    return ranked.agg(news_block(entries).alias("news")).scalar()


def ranked_news_array(ranked: DataFrame) -> Column:
    """Ranked items → ARRAY<STRUCT<title, source, date, summary>> in rank order, as a scalar.

    ``ranked`` holds at most ``max_results`` rows, so the collect is bounded.
    """
    entries = F.array_sort(F.collect_list(F.struct("rank", "title", "source", "date", "summary")))
    return ranked.agg(F.transform(entries, lambda x: F.struct(
        x["title"].alias("title"), x["source"].alias("source"),
        x["date"].alias("date"), x["summary"].alias("summary"))).alias("news")).scalar()
