"""Relevance ranking, triage and budgets over a corpus (id, path, text).

Corpus statistics are one aggregate whose single row comes to the driver and goes back as literals, so ranking is a narrow map
followed by a top-k (TakeOrderedAndProject): no shuffle of texts.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import graph as G

K1, B = 1.5, 0.75
# Terms of risk, weights of priorities, the least share of a source, sizes of the two passes of a review.
RISK_TERMS = ("deadline", "return false", "open(lockpath", "writefilesync", "renamesync", "atomic", "todo", "fixme", "hack")
WEIGHTS = {"high": 2.0, "normal": 1.0, "low": 0.25}
LEAST = 10
PASS1, PASS2, MOST_PASS2 = 600, 2000, 3
FLOOR, BOOST = 0.1, 2.0  # score of a changed file that doesn't rank, and what a changed one counts
SCAN, SEED = 50, 100.0


def term_stats(corpus: DataFrame, terms: Sequence[str], text: str = "text") -> DataFrame:
    """(term, df, idf, n_docs, avgdl): document frequency by whole words; idf with add-half smoothing."""
    c = F.col("_low")
    totals = corpus.select(F.lower(text).alias("_low")).agg(F.count("*").alias("n"), F.avg(T.token_count(c)).alias("avgdl"), *[F.coalesce(F.sum(T.has_word(c, t).cast("int")), F.lit(0)).alias(f"df_{i}") for i, t in enumerate(terms)])
    rows = F.explode(F.array(*[F.struct(F.lit(t).alias("term"), F.col(f"df_{i}").alias("df")) for i, t in enumerate(terms)]))
    idf = F.log((F.col("n") - F.col("r.df") + 0.5) / (F.col("r.df") + 0.5) + 1)
    return totals.select("n", "avgdl", rows.alias("r")).select("r.term", "r.df", idf.alias("idf"), F.col("n").alias("n_docs"), F.coalesce("avgdl", F.lit(1.0)).alias("avgdl"))


def bm25(text: Column, stats: Sequence, length: Column | None = None, lowered: bool = False) -> Column:
    """Score of a text for the terms of `stats` (rows of term_stats)."""
    length = T.token_count(text) if length is None else length
    # as elements of one array, so that each frequency and the length are worked out once a text
    parts = F.array(*[F.struct(F.lit(row["idf"] if row["idf"] is not None else math.log(1.5)).alias("idf"), T.word_occurrences(text, row["term"], lowered).cast("double").alias("tf"), F.lit(row["avgdl"]).alias("avgdl")) for row in stats])
    if not stats:
        return F.lit(0.0)
    sized = F.transform(F.array(length), lambda n: F.aggregate(parts, F.lit(0.0), lambda a, x: a + F.when(x["tf"] > 0, x["idf"] * x["tf"] * (K1 + 1) / (x["tf"] + K1 * (1 - B + B * n / x["avgdl"]))).otherwise(0.0)))
    return F.when(F.length(text) == 0, 0.0).otherwise(F.element_at(sized, 1))


def has_term(value: Column, term: str) -> Column:
    """Whether a value has a term as a whole word, underscores apart; a term with other signs than letters counts anywhere."""
    if not re.fullmatch(r"[A-Za-z0-9_]+", term):
        return value.contains(term)
    return F.regexp_replace(F.lower(value), "_", " ").rlike(rf"(?<![A-Za-z0-9_]){term.lower()}(?![A-Za-z0-9_])")


def metadata_score(terms: Sequence[str], path: Column, names: Column, heads: Column) -> Column:
    """Points for terms: 3 in the file's name; 1 a folder, 2 at most; 2 a declared name, 6 at most; 2 a heading, 4 at most."""
    parts = F.split(path, r"[/\\]")
    any_term = lambda x: reduce(lambda a, b: a | b, [has_term(x, t) for t in terms], F.lit(False))
    hits = lambda values: F.size(F.filter(values, lambda x: any_term(T.split_camel(x))))
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    return F.when(any_term(name), 3).otherwise(0) + F.least(F.lit(2), hits(folders)) + F.least(F.lit(6), 2 * hits(names)) + F.least(F.lit(4), 2 * hits(heads))


def content_score(terms: Sequence[str], text: Column) -> Column:
    """Occurrences of each term anywhere in the text, five of each at most."""
    return sum((F.least(F.lit(5), T.occurrences(F.lower(text), t)) for t in terms), F.lit(0))


def rank_documents(corpus: DataFrame, terms: Sequence[str], k: int | None = 10, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The k best documents with a score above 0; ties by key. k None: all of them."""
    stats = term_stats(corpus, terms, text).collect()  # a row a term
    # lower case is its own projection: the optimizer keeps apart what is dear and used more than once
    scored = corpus.select(key, F.lower(text).alias("_low")).select(key, F.round(bm25(F.col("_low"), stats, lowered=True), 6).alias("score"))
    # the filter comes after the top-k: in front of it the whole score would be worked out twice
    return (scored.orderBy(F.desc("score"), key).limit(k) if k else scored).where("score > 0")


def matched_terms(text: Column, terms: Sequence[str] = RISK_TERMS) -> Column:
    low = F.lower(text)
    return F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(low, t))


def evidence_lines(corpus: DataFrame, terms: Sequence[str] = RISK_TERMS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per line with a term: its number from 1 and the first term. Lines of texts without any term are never made."""
    lines = corpus.where(F.size(matched_terms(F.col(text), terms)) > 0).select(key, F.posexplode(F.split(text, "\n", -1)).alias("p", "line"))
    return lines.select(key, (F.col("p") + 1).cast("long").alias("line_no"), F.try_element_at(matched_terms(F.col("line"), terms), F.lit(1)).alias("term"), T.trim_all(F.col("line")).alias("line")).where("term is not null")


def cut_to_budget(text: Column, budget: int | Column) -> Column:
    """(lines, tokens): the longest prefix of lines of budget - 5 tokens, of which the last may be the one that crosses 5 characters a token of
    the budget: a fold over the lines of a text, without windows."""
    budget = F.lit(budget) if isinstance(budget, int) else budget
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("tokens"), F.lit(0).alias("chars"), F.lit(True).alias("open"))

    def step(a: Column, line: Column) -> Column:
        tokens = a["tokens"] + T.token_count(line)
        fits = a["open"] & (tokens <= budget - 5) & (a["chars"] <= 5 * budget)
        return F.struct(F.when(fits, a["n"] + 1).otherwise(a["n"]).alias("n"), F.when(fits, tokens).otherwise(a["tokens"]).alias("tokens"), (a["chars"] + F.length(line) + 1).alias("chars"), fits.alias("open"))

    return F.aggregate(F.split(text, "\n", -1), start, step)


def truncate_to_budget(corpus: DataFrame, budget: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, total, lines, tokens): the lines that a read within a budget keeps of each text and what it returns: all, or the prefix and a line
    that says how many tokens are left out (four more tokens)."""
    total = T.token_count(F.col(text))
    cut = cut_to_budget(F.col(text), budget)
    read = corpus.select(key, total.cast("long").alias("total"), F.when(total > budget, cut).alias("_cut"), F.size(F.split(text, "\n", -1)).alias("_lines"))
    return read.select(key, "total", F.coalesce("_cut.n", "_lines").cast("long").alias("lines"), F.when(F.col("_cut").isNull(), F.col("total")).otherwise(F.col("_cut.tokens") + 4).cast("long").alias("tokens"))


def read_text(text: Column, budget: Column) -> Column:
    """What a read within a budget returns of a text."""
    total, cut = T.token_count(text), cut_to_budget(text, budget)
    made = F.transform(F.array(cut), lambda c: F.concat(F.array_join(F.slice(F.split(text, "\n", -1), 1, c["n"]), "\n"), F.lit("\n[...truncated, ~"), (total - c["tokens"]).cast("string"), F.lit(" more tokens]")))
    return F.when(total <= budget, text).otherwise(F.element_at(made, 1))


def allocate(sources: DataFrame, budget: int, request: str = "request", tokens: str = "tokens", priority: str = "priority") -> DataFrame:
    """Each source's share of its request's budget: all of it if everything fits, else by weighted size, LEAST at least. The totals are
    combined before they are shuffled and come back by an adaptive join, so a large request is never one task."""
    weight = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv]), F.col(priority)), F.lit(1.0))
    weighted = sources.withColumn("_w", weight * F.col(tokens))
    totals = weighted.groupBy(request).agg(F.sum(tokens).alias("_all"), F.sum("_w").alias("_sum"))
    share = F.greatest(F.lit(LEAST), F.floor(F.col("_w") / F.col("_sum") * budget)).cast("long")
    return weighted.join(totals, request).withColumn("allocated", F.when(F.col("_all") <= budget, F.col(tokens)).otherwise(share)).drop("_w", "_all", "_sum")


def redistribute(sources: list[tuple[int, int, str]]) -> list[int]:
    """Shares of one request's sources (allocated, tokens, priority), in order, after what sources have too much went to those of the same
    or a higher priority that lack some, by weight, until none has too much."""
    order = {"high": 3, "normal": 2, "low": 1}
    share = [a for a, _, _ in sources]
    need = [t for _, t, _ in sources]
    rank = [order.get(p, 2) for _, _, p in sources]
    weight = [WEIGHTS.get(p, 1.0) for _, _, p in sources]
    changed = True
    while changed:
        changed = False
        for i in range(len(share)):
            if share[i] <= need[i]:
                continue
            surplus, share[i] = share[i] - need[i], need[i]
            takers = [k for k in range(len(share)) if k != i and share[k] < need[k] and rank[k] >= rank[i]]
            total = sum(weight[k] for k in takers)
            for k in takers:
                share[k] += int(weight[k] / total * surplus)
            changed = changed or bool(takers)
    return share


def assemble(sources: DataFrame, budget: int) -> DataFrame:
    """sources(request, position, name, text, priority) as one context a request: (request, context, tokens). A request's sources are a bounded
    top-k, so one request is one group; only sizes go through it, texts are cut afterwards by built-in functions."""
    sized = sources.withColumn("tokens", T.token_count(F.col("text")).cast("long"))
    shares = allocate(sized.drop("text", "name"), budget)

    def per_request(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("position", ignore_index=True)
        if pdf["tokens"].sum() > budget:
            pdf["allocated"] = redistribute(list(zip(pdf["allocated"], pdf["tokens"], pdf["priority"])))
        return pdf

    settled = shares.groupBy("request").applyInPandas(per_request, shares.schema).select("request", "position", "allocated")
    texts = sized.join(settled, ["request", "position"]).withColumn("_full", F.col("tokens") <= F.col("allocated")).withColumn("_read", read_text(F.col("text"), F.col("allocated").cast("int")))
    used = T.token_count(F.col("_read"))
    how = F.when(F.sum("tokens").over(Window.partitionBy("request")) <= budget, F.concat(F.lit("full, "), F.col("tokens"), F.lit("t"))).otherwise(F.concat(F.when(F.col("_full"), "full").otherwise("truncate"), F.lit(", "), used, F.lit("t of "), F.col("tokens"), F.lit("t")))
    part = F.concat(F.lit("## "), F.col("name"), F.lit(" ("), how, F.lit(")\n\n"), F.col("_read"))
    parts = texts.select("request", F.struct("position", part.alias("part")).alias("p"), used.alias("used"))
    return parts.groupBy("request").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda x: x["part"]), "\n\n---\n\n").alias("context"), F.sum("used").cast("long").alias("tokens"))


def review(corpus: DataFrame, terms: Sequence[str], changed: DataFrame | None = None, risks: Sequence[str] = RISK_TERMS, k: int = 10, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Two passes over the best documents of a query and the changed ones: (key, score, full_tokens, pass1_tokens, flagged, risks, pass2_tokens). The first
    pass reads each within PASS1 tokens and looks for terms of risk in what it read; the second reads the first MOST_PASS2 flagged that the
    first didn't read whole."""
    ranked = rank_documents(corpus, terms, k, key, text)
    if changed is not None:
        both = ranked.join(changed.select(key).distinct().withColumn("_changed", F.lit(True)), key, "full")
        ranked = both.select(key, F.when(F.col("_changed"), BOOST * F.coalesce("score", F.lit(FLOOR))).otherwise(F.col("score")).alias("score"))
    read = corpus.select(key, text).join(ranked, key).withColumn("_one", read_text(F.col(text), F.lit(PASS1)))
    total = T.token_count(F.col(text))
    passed = read.select(key, "score", total.cast("long").alias("full_tokens"), T.token_count(F.col("_one")).cast("long").alias("pass1_tokens"), matched_terms(F.col("_one"), tuple(dict.fromkeys(risks))).alias("risks"))
    passed = passed.persist()  # sizes and terms of the candidates, read three times below
    again = passed.where((F.size("risks") > 0) & (F.col("full_tokens") > PASS1)).orderBy(F.desc("score"), key).limit(MOST_PASS2).select(key)
    second = corpus.select(key, text).join(F.broadcast(again), key, "left_semi").select(key, T.token_count(read_text(F.col(text), F.lit(PASS2))).cast("long").alias("pass2_tokens"))  # MOST_PASS2 rows
    joined = passed.join(F.broadcast(second), key, "left")
    return joined.select(key, F.round("score", 6).alias("score"), "full_tokens", "pass1_tokens", (F.size("risks") > 0).alias("flagged"), F.array_join("risks", ",").alias("risks"), F.coalesce("pass2_tokens", F.lit(0)).alias("pass2_tokens"))


def review_totals(reviewed: DataFrame) -> DataFrame:
    full, one, two = (F.coalesce(F.sum(c), F.lit(0)).cast("long") for c in ("full_tokens", "pass1_tokens", "pass2_tokens"))
    totals = reviewed.agg(full.alias("full_tokens"), one.alias("pass1_tokens"), two.alias("pass2_tokens"), F.coalesce(F.sum((F.col("pass2_tokens") > 0).cast("long")), F.lit(0)).alias("pass2_files"))
    saved = F.col("full_tokens") - F.col("pass1_tokens") - F.col("pass2_tokens")
    return totals.withColumns({"saved_tokens": saved, "reduction_pct": F.when(F.col("full_tokens") <= 0, 0.0).otherwise(F.round(saved * 100 / F.col("full_tokens"), 1))})


def review_clusters(reviewed: DataFrame) -> DataFrame:
    """(term, n_files, files): flagged documents by their first term."""
    term = F.substring_index("risks", ",", 1)
    return reviewed.where("flagged").groupBy(term.alias("term")).agg(F.count("*").alias("n_files"), F.array_join(F.array_sort(F.collect_list(F.col(reviewed.columns[0]))).cast("array<string>"), ",").alias("files"))


def select_files(features: DataFrame, edges: DataFrame, terms: Sequence[str], seeds: Sequence[str] = (), folders: Sequence[str] = (), depth: int = 1, k: int = 15, stats: Sequence | None = None) -> DataFrame:
    """(file_id, score, priority): the files for a query. features(file_id, path, content, names, heads); seeds are paths, folders are paths whose
    matching files all count as high; then the best SCAN files, what they share in imports and what the high ones import."""
    stats = term_stats(features, terms, "content").collect() if stats is None else stats
    path = G.clean_path(F.col("path"))
    scored = features.select("file_id", path.alias("path"), F.round(metadata_score(terms, F.col("path"), F.col("names"), F.col("heads")) + bm25(F.col("content"), stats), 6).alias("score")).persist()  # a narrow row a file, read by three ways in
    seeded = scored.where(F.col("path").isin(*seeds) if seeds else F.lit(False)).select(F.col("file_id").alias("node"), F.lit(SEED).alias("score"), F.lit("high").alias("priority"), F.lit(0).alias("_from"))
    inside = reduce(lambda a, b: a | b, [F.col("path").startswith(f.rstrip("/") + "/") for f in folders], F.lit(False))
    foldered = scored.where(inside & (F.col("score") > 0)).select(F.col("file_id").alias("node"), F.greatest("score", F.lit(float(G.HIGH))).alias("score"), F.lit("high").alias("priority"), F.lit(1).alias("_from"))
    best = scored.where("score > 0").orderBy(F.desc("score"), "file_id").limit(SCAN)
    ranked = best.select(F.col("file_id").alias("node"), "score", F.when(F.col("score") >= G.HIGH, "high").otherwise("normal").alias("priority"), F.lit(2).alias("_from"))
    first = seeded.unionByName(foldered).unionByName(ranked).groupBy("node").agg(F.min_by(F.struct("score", "priority"), "_from").alias("c")).select("node", "c.score", "c.priority")
    if depth > 0:
        first, edges = first.persist(), edges.where("resolved IS NOT NULL").persist()  # numbers only, read by each level
        boosted = G.shared_boost(first, edges).withColumn("priority", F.lit("low"))
        first = G.expand_candidates(first.unionByName(boosted), edges, depth)
    return first.orderBy(F.desc("score"), "node").limit(k).select(F.col("node").alias("file_id"), "score", "priority")


def gather(features: DataFrame, edges: DataFrame, terms: Sequence[str], budget: int, **options) -> DataFrame:
    """(request, context, tokens): the selected files of a query as one context within a budget."""
    chosen = select_files(features, edges, terms, **options)
    placed = chosen.withColumn("position", F.row_number().over(Window.orderBy(F.desc("score"), "file_id")))  # a top-k
    sources = features.join(F.broadcast(placed), "file_id").select(F.lit(1).alias("request"), "position", G.clean_path(F.col("path")).alias("name"), F.col("content").alias("text"), "priority")
    return assemble(sources, budget)
