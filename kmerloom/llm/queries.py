"""Catalogue of the training-data queries."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.traverse import connected_components
from ..session import checkpoint_dir, cut, dropped_table, stored, table
from . import color_sets, distinct, kmer_rows, leak, near_dup, overlap, packing, seen, sentences, spans, topk

TOP = 20


def reads(spark: SparkSession, d: str) -> DataFrame:
    """One row per read_id, the latest delivery: read in bases and occ_count (null as 1)."""
    rows = table(spark, d, "read_counts").where(F.col("read_id").isNotNull())
    latest = rows.groupBy("read_id").agg(F.max_by(F.struct("read", "occ_count"), F.coalesce("loaded_at", "seen_at")).alias("r"))
    return latest.select(
        "read_id", F.translate(F.upper("r.read"), "U", "T").alias("read"), F.coalesce("r.occ_count", F.lit(1)).alias("occ_count")
    )


def variants(spark: SparkSession, d: str) -> DataFrame:
    """(read_id, seq): the texts of the occurrences of every read, in bases; unchanged ones once.

    A read's occurrences without rows in mismatches equal the read; void and repeated rows of mismatches
    are ignored, and of two letters for one place the later in the alphabet counts.
    """
    all_ = reads(spark, d).where(F.col("read").isNotNull())
    letter = F.translate(F.upper("mismatch_char"), "U", "T")
    m = table(spark, d, "mismatches").where(F.length("mismatch_char") == 1).select("read_id", "id_read", "position", letter.alias("ch"))
    m = m.groupBy("read_id", "id_read", "position").agg(F.max("ch").alias("ch"))
    real = m.join(all_, "read_id").where(F.col("position").between(0, F.length("read") - 1) & F.col("id_read").between(0, F.col("occ_count") - 1))
    # one occurrence's changes: bounded by the read's length
    changes = real.groupBy("read_id", "id_read").agg(F.first("read").alias("read"), F.array_sort(F.collect_list(F.struct("position", "ch"))).alias("subs"))
    put = F.aggregate("subs", F.col("read"), lambda text, s: F.overlay(text, s["ch"], s["position"] + 1, F.lit(1)))
    changed = stored(changes.select("read_id", put.alias("seq")))
    counts = changed.groupBy("read_id").agg(F.count(F.lit(1)).alias("n"))
    plain = all_.join(counts, "read_id", "left").where(F.coalesce("n", F.lit(0)) < F.col("occ_count")).select("read_id", F.col("read").alias("seq"))
    texts = stored(changed.unionByName(plain))
    dropped_table(changed)
    return texts


def _similar(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(read_id, set_id, whole) of all reads' occurrences (whether the text has a window without non-bases), and the similar pairs of sets."""
    members, numbered = near_dup.number_members(texts)
    dropped_table(texts)
    return members, near_dup.similar_pairs(numbered)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of reads with a pair of occurrences that share at least half of their distinct 9-base windows.

    By its definition it lists every pair, those of exact copies included; :func:`p1_groups` doesn't.
    """
    members, pairs = _similar(variants(spark, d))
    # copies of a text that has a window at all are similar: they meet as members of one set
    copies = members.where("whole").groupBy("set_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("set_id").alias("a"), F.col("set_id").alias("b"))
    a, b = members.select(F.col("read_id").alias("ra"), F.col("set_id").alias("a")), members.select(F.col("read_id").alias("rb"), F.col("set_id").alias("b"))
    both = pairs.select("a", "b").unionByName(copies).join(a, "a").join(b, "b").where(F.col("ra") != F.col("rb"))
    return both.select(F.least("ra", "rb").alias("read_id_a"), F.greatest("ra", "rb").alias("read_id_b")).distinct()


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    """Per read: the least read_id of its group of similar reads, and its links.

    Groups are the components of reads under similarity and equality of any occurrences. Links count the
    similar pairs of distinct texts that the read's occurrences are in; copies stay members of one text
    and aren't expanded into pairs. Reads without a window are groups of their own, without links.
    """
    texts = variants(spark, d)
    members, pairs = _similar(texts)
    members, pairs = members.select("read_id", "set_id"), stored(pairs.select("a", "b"))
    hub = members.groupBy("read_id").agg(F.min("set_id").alias("a"))
    own = members.join(hub, "read_id").select("a", F.col("set_id").alias("b"))
    groups = connected_components(pairs.unionByName(own), members.select(F.col("set_id").alias("v")).distinct())
    degree = pairs.select(F.explode(F.array("a", "b")).alias("set_id")).groupBy("set_id").agg(F.count(F.lit(1)).alias("links"))
    per_set = members.join(groups.withColumnRenamed("v", "set_id"), "set_id").join(degree, "set_id", "left")
    per_read = per_set.groupBy("read_id").agg(F.first("component").alias("component"), F.sum(F.coalesce("links", F.lit(0))).alias("n_links"))
    named = per_read.groupBy("component").agg(F.min("read_id").alias("group_id"))
    rows = per_read.join(named, "component").select("read_id", "group_id", "n_links")
    return reads(spark, d).select("read_id").join(rows, "read_id", "left").select("read_id", F.coalesce("group_id", "read_id").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def _spans(spark: SparkSession, d: str) -> DataFrame:
    of_reads = reads(spark, d).select(F.col("read_id").alias("rec_id"), F.col("read").alias("text"))
    of_files = table(spark, d, "genomes").select(F.col("genome_id").alias("rec_id"), F.col("filename").alias("text"))
    kind = lambda df, k: df.select(F.lit(k).alias("rec_kind"), "*")
    return kind(spans.shared_spans(of_reads, 48, "ACGT"), "read").unionByName(kind(spans.shared_spans(of_files, 24), "file"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Maximal runs of letters of reads (48 bases) and file names (24 characters) that other records hold too."""
    return _spans(spark, d)


def p2_shared_share(spark: SparkSession, d: str) -> DataFrame:
    """Per record its length, the letters that other records share and their share; a record that shares nothing, be it short, empty or null, has a share of 0."""
    of_reads = reads(spark, d).select(F.lit("read").alias("rec_kind"), F.col("read_id").alias("rec_id"), F.length("read").alias("n_chars"))
    of_files = table(spark, d, "genomes").select(F.lit("file").alias("rec_kind"), F.col("genome_id").cast("bigint").alias("rec_id"), F.length("filename").alias("n_chars"))
    shared = _spans(spark, d).groupBy("rec_kind", "rec_id").agg(F.sum("span_len").alias("shared_chars"), F.count(F.lit(1)).alias("n_spans"))
    all_ = of_reads.unionByName(of_files).join(shared, ["rec_kind", "rec_id"], "left").fillna(0, ["shared_chars", "n_spans"])
    share = F.when(F.col("shared_chars") > 0, F.round(F.col("shared_chars") / F.col("n_chars"), 6)).otherwise(F.lit(0.0))
    return all_.withColumn("n_chars", F.coalesce("n_chars", F.lit(0))).withColumn("share", share)


VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"  # the driver's file; it is shipped to the executors


def _token_counts(spark: SparkSession, d: str) -> DataFrame:
    return cut(packing.token_counts(table(spark, d, "documents"), VOCABULARY))


def p8_packing(spark: SparkSession, d: str) -> DataFrame:
    """Container and place of every text, or piece of a text longer than 2,048 tokens."""
    return packing.pack(_token_counts(spark, d))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers, the least number that could hold all tokens, tokens and the share of the containers' space that is used."""
    loads = p8_packing(spark, d).groupBy("container").agg(F.sum("n_tokens").alias("load"))
    return loads.agg(
        F.count(F.lit(1)).alias("containers"), F.ceil(F.sum("load") / packing.CAPACITY).alias("least"), F.sum("load").alias("tokens"), F.max("load").alias("fullest"),
        (F.sum("load") / (F.count(F.lit(1)) * packing.CAPACITY)).alias("fill"),
    )


def p8_valid(spark: SparkSession, d: str) -> DataFrame:
    """Per text whether its tokens are all packed, once and in order, split only if it is longer than a container, and into containers that hold no more than they may."""
    counts = _token_counts(spark, d)
    rows = cut(packing.pack(counts))
    full = F.lit(packing.CAPACITY)
    per_bin = rows.groupBy("container").agg((F.sum("n_tokens") <= full).alias("fits"), F.max("position").alias("last"), F.count_distinct("position").alias("n"))
    pieces = rows.join(per_bin, "container").groupBy("doc_id").agg(
        F.sum("n_tokens").alias("packed"), F.count(F.lit(1)).alias("k"), F.max("piece").alias("last_piece"),
        F.bool_and(F.col("fits") & (F.col("last") + 1 == F.col("n")) & (F.col("first_token") == F.col("piece") * full) & (F.col("n_tokens") <= full)).alias("ok"),
    )
    valid = (F.col("packed") == F.col("n")) & (F.col("k") == F.ceil(F.col("n") / full)) & (F.col("last_piece") == F.col("k") - 1) & F.col("ok")
    return counts.where("n > 0").join(pieces, "doc_id", "left").select("doc_id", F.coalesce(valid, F.lit(False)).alias("valid"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents and evaluation items that share 50 consecutive letters or digits."""
    return leak.leaked_pairs(table(spark, d, "documents"), table(spark, d, "benchmark"))


def p9_leaked_items(spark: SparkSession, d: str) -> DataFrame:
    """Per leaked item the number of documents that hold a part of it."""
    return p9_found(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"))


def _inserted(spark: SparkSession, d: str) -> DataFrame:
    return kmer_rows.inserted_kmers(table(spark, d, "kmer_inserts"), table(spark, d, "meta"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose k-mer also occurs at a smaller insert_id."""
    sizes = table(spark, d, "kmer_inserts").select(F.col("insert_id").alias("id"))
    answers = seen.seen_before(_inserted(spark, d), F.col("insert_id"), F.col("graph_id"), F.col("kmer"), sizes=sizes)
    return answers.where("seen").select(F.col("id").alias("insert_id")).distinct()


def p4_appended(spark: SparkSession, d: str) -> DataFrame:
    """The same rows, told by an index that is stored and takes the table in three batches of arrival."""
    rows = _inserted(spark, d).where(F.col("insert_id").isNotNull())
    low, high, n = table(spark, d, "kmer_inserts").agg(F.min("insert_id"), F.max("insert_id"), F.count(F.lit(1))).first()
    low, high = low or 0, high or 0
    index = seen.SeenIndex.create(spark, f"{checkpoint_dir(spark)}/seen-{uuid.uuid4()}", n)
    edges = [low + (high + 1 - low) * i // 3 for i in range(4)]
    parts = [index.append(rows.where((F.col("insert_id") >= a) & (F.col("insert_id") < b)), F.col("insert_id"), F.col("graph_id"), F.col("kmer")) for a, b in zip(edges, edges[1:])]
    answers = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return answers.where("seen").select(F.col("id").alias("insert_id")).distinct()


WANTED_WRONG = 400  # false answers that the smaller hashes of p4_wrong_rate are chosen for: enough to measure a rate


def _p4_measured(spark: SparkSession, d: str) -> DataFrame:
    """(bits, answers, repeats, missed, wrong, expected) for hashes of 64 bits and for hashes small enough to err."""
    rows = cut(_inserted(spark, d).where(F.col("insert_id").isNotNull()).select("insert_id", "graph_id", "kmer").distinct())
    first = rows.groupBy("graph_id", "kmer").agg(F.min("insert_id").alias("first"))
    true_ = cut(rows.join(first, ["graph_id", "kmer"]).where(F.col("insert_id") > F.col("first")).select(F.col("insert_id").alias("id")).distinct())
    probes, repeats = rows.select("insert_id").distinct().count(), true_.count()
    keys = probes - repeats
    small = min(63, max(16, math.floor(math.log2(max(1.0, keys * keys / 2 / WANTED_WRONG)))))
    out = None
    for bits in (small, 64):
        answers = seen.seen_before(rows, F.col("insert_id"), F.col("graph_id"), F.col("kmer"), bits=bits)
        said = cut(answers.where("seen").select("id").distinct())
        both = said.withColumn("said", F.lit(True)).join(true_.withColumn("so", F.lit(True)), "id", "full")
        one = both.agg(F.count_if(F.col("so").isNull()).alias("wrong"), F.count_if(F.col("said").isNull()).alias("missed")).select(
            F.lit(bits).alias("bits"), F.lit(probes).cast("bigint").alias("answers"), F.lit(repeats).cast("bigint").alias("repeats"), "missed", "wrong",
            F.lit(keys * (keys - 1) / 2 / 2.0**bits).alias("expected"),
        )
        out = one if out is None else out.unionByName(one)
    return out


def p4_wrong_rate(spark: SparkSession, d: str) -> DataFrame:
    """Per size of the remembered hashes: answers, wrong answers (against exact ones), their rate and the rate that is expected."""
    share = lambda c: (F.col(c) / F.greatest("answers", F.lit(1))).alias(f"{c}_rate")
    return _p4_measured(spark, d).select("bits", "answers", "missed", "wrong", share("wrong"), share("expected"))


def p4_rate_check(spark: SparkSession, d: str) -> DataFrame:
    """Answers and true repeats; repeats that small hashes, and large ones, miss; whether their wrong answers are as many as stated (six standard deviations)."""
    as_stated = F.abs(F.col("wrong") - F.col("expected")) <= 6 * F.sqrt("expected") + 1
    return _p4_measured(spark, d).groupBy("answers", "repeats").agg(F.sum("missed").alias("missed"), F.bool_and(as_stated).alias("as_stated"))


P5_ERROR = 0.045  # relative standard error of the estimates: 512 registers
_KINDS = ["day", "genome", "week", "genome_week", "all", "day_genome"]


def _p5_rows(spark: SparkSession, d: str) -> DataFrame:
    day = F.datediff(F.to_date("inserted_at"), F.lit("1970-01-01").cast("date"))
    return _inserted(spark, d).withColumns({"day": day, "genome": F.col("id_genome")})


def _p5_groups() -> list[F.Column]:
    """(kind, day, genome, week) of each kind of group but the last, of rows with a day and a genome; -1 where a part isn't used or null."""
    none = F.lit(-1).cast("bigint")
    day, genome = F.coalesce(F.col("day").cast("bigint"), none), F.coalesce(F.col("genome").cast("bigint"), none)
    week = F.when(day < 0, none).otherwise(F.floor((day + 3) / 7))  # weeks begin on Mondays
    parts = [(day, none, none), (none, genome, none), (none, none, week), (none, genome, week), (none, none, none)]
    return [F.struct(F.lit(i).cast("bigint").alias("kind"), a.alias("day"), b.alias("genome"), c.alias("week")) for i, (a, b, c) in enumerate(parts)]


def _p5_estimates(spark: SparkSession, d: str, confidence: float) -> DataFrame:
    m = distinct.registers_for(P5_ERROR)
    parts = distinct.sketches(_p5_rows(spark, d), ["day", "genome"], F.col("graph_id"), F.col("kmer"), m=m)
    base = cut(distinct.merged(parts, ["day", "genome"], m))
    unions = base.select(F.explode(F.array(*_p5_groups())).alias("g"), "registers", "hashes").select("g.*", "registers", "hashes")
    combined = distinct.united(unions, ["kind", "day", "genome", "week"], m)
    cells = base.select(F.lit(len(_KINDS) - 1).cast("bigint").alias("kind"), "day", "genome", F.lit(-1).cast("bigint").alias("week"), "registers", "hashes")
    return distinct.estimates(combined.unionByName(cells), confidence, m)


def _p5_named(rows: DataFrame, *values: str) -> DataFrame:
    known = lambda c: F.when(F.col(c) >= 0, F.col(c).cast("int"))
    return rows.select(
        F.element_at(F.array(*map(F.lit, _KINDS)), F.col("kind").cast("int") + 1).alias("kind"),
        F.date_add(F.lit("1970-01-01").cast("date"), known("day")).alias("day"), known("genome").alias("genome"),
        F.date_add(F.lit("1970-01-01").cast("date"), known("week") * 7 - 3).alias("week"), *values,
    )


def p5_distinct_counts(spark: SparkSession, d: str) -> DataFrame:
    """Estimated distinct k-mers with 95 % interval per day, genome, day and genome, week, genome and week, and in all.

    The day, genome and week columns are null where they are not part of the group (``kind`` names the
    group) and where the row's own value is null.
    """
    return _p5_named(_p5_estimates(spark, d, 0.95), "estimate", "low", "high")


def p5_interval_check(spark: SparkSession, d: str) -> DataFrame:
    """Exact distinct k-mers of every group, and whether its interval (at a confidence of 1 - 1e-9) holds them."""
    rows = _p5_rows(spark, d)
    cell = F.struct(F.lit(len(_KINDS) - 1).cast("bigint").alias("kind"), F.coalesce(F.col("day").cast("bigint"), F.lit(-1).cast("bigint")).alias("day"),
                    F.coalesce(F.col("genome").cast("bigint"), F.lit(-1).cast("bigint")).alias("genome"), F.lit(-1).cast("bigint").alias("week"))
    keys = ["kind", "day", "genome", "week"]
    distinct_ = rows.select(F.explode(F.array(*_p5_groups(), cell)).alias("g"), "graph_id", "kmer").select("g.*", "graph_id", "kmer").distinct()
    exact = distinct_.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_kmers"))
    told = _p5_estimates(spark, d, 1 - 1e-9)
    both = exact.join(told, keys, "full").withColumn("within", F.coalesce(F.col("n_kmers").between(F.floor("low"), F.ceil("high")), F.lit(False)))
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    named = _p5_named(both, "n_kmers", "within")
    return named.select("kind", F.concat_ws("/", part("day"), part("genome"), part("week")).alias("of_day_genome_week"), "n_kmers", "within")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """The 20 color sets that most rows of kmers have."""
    return p6_top_color_sets(spark, d).select("annot_hex")


def p6_top_color_sets(spark: SparkSession, d: str) -> DataFrame:
    """The 20 color sets that most rows of kmers have, with their exact numbers of rows."""
    rows = color_sets.color_set_rows(table(spark, d, "kmers"), table(spark, d, "color_dict"))
    return topk.most_frequent(rows, TOP).select(F.hex("value").alias("annot_hex"), "n_rows")


def _kmer_sets(spark: SparkSession, d: str) -> DataFrame:
    return cut(overlap.identifier_sets(table(spark, d, "kmers")))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Genomes sharing at least half of the distinct k-mers of the smaller one: proposed by the sample, then counted."""
    found = overlap.sharing_at_least_half(_kmer_sets(spark, d))
    return found.select(F.col("a").alias("genome_a"), F.col("b").alias("genome_b"))


def p7_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """Estimated overlap of every pair of genomes that shares a sampled k-mer, with its confidence interval."""
    return overlap.estimated_overlaps(_kmer_sets(spark, d)).withColumnsRenamed({"a": "genome_a", "b": "genome_b"})


def p7_interval_check(spark: SparkSession, d: str) -> DataFrame:
    """Exact overlap of every pair of genomes, and whether its estimate's interval (z = 6.5) holds it."""
    return overlap.interval_check(_kmer_sets(spark, d)).withColumnsRenamed({"a": "genome_a", "b": "genome_b"})


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Ends of the sentence units of every document."""
    return sentences.sentence_ends(table(spark, d, "documents"))


def p10_units_per_language(spark: SparkSession, d: str) -> DataFrame:
    """Per stated language: documents with units, units, and the longest unit's letters."""
    docs = table(spark, d, "documents")
    ends = p10_found(spark, d)
    per_doc = ends.groupBy("doc_id").agg(F.count(F.lit(1)).alias("units"), F.max("end_char").alias("last"))
    out = docs.select("doc_id", "lang").join(per_doc, "doc_id")
    return out.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), F.sum("units").alias("units"), F.max("last").alias("longest_text"))


QUERIES = {
    "p1_found": p1_found,
    "p1_groups": p1_groups,
    "p2_found": p2_found,
    "p2_shared_share": p2_shared_share,
    "p8_packing": p8_packing,
    "p8_fill": p8_fill,
    "p8_valid": p8_valid,
    "p9_found": p9_found,
    "p9_leaked_items": p9_leaked_items,
    "p10_found": p10_found,
    "p10_units_per_language": p10_units_per_language,
    "p4_found": p4_found,
    "p4_appended": p4_appended,
    "p4_wrong_rate": p4_wrong_rate,
    "p4_rate_check": p4_rate_check,
    "p5_distinct_counts": p5_distinct_counts,
    "p5_interval_check": p5_interval_check,
    "p6_found": p6_found,
    "p6_top_color_sets": p6_top_color_sets,
    "p7_found": p7_found,
    "p7_overlaps": p7_overlaps,
    "p7_interval_check": p7_interval_check,
}

_COLOR_SET_ROWS = """sets AS (SELECT hex(annot) AS annot_hex FROM kmers WHERE annot IS NOT NULL
      UNION ALL SELECT e.hex FROM kmers k JOIN (SELECT last_index - n + 1 + i AS pos,
        substr(annot_array, (i * size_annot * 2 + 1)::BIGINT, (size_annot * 2)::BIGINT) AS hex
        FROM (SELECT last_index, size_annot, hex(annot_array) AS annot_array, octet_length(annot_array) // size_annot AS n,
                     unnest(range(octet_length(annot_array) // size_annot)) AS i FROM color_dict)) e
      ON k.dict_pos = e.pos WHERE k.annot IS NULL)"""

_INSERTED = """ins AS (SELECT insert_id, i.graph_id, replace(upper(left(array_kmers, k)), 'U', 'T') AS kmer, k
      FROM kmer_inserts i JOIN meta USING (graph_id))"""

_SPANS = """recs AS (
        SELECT 'read' AS rec_kind, read_id AS rec_id, 48 AS w, replace(upper(arg_max(read, loaded_at)), 'U', 'T') AS text
        FROM read_counts GROUP BY read_id
        UNION ALL SELECT 'file', genome_id, 24, filename FROM genomes),
      wins AS (SELECT rec_kind, rec_id, w, p AS start, substr(text, p + 1, w) AS win
        FROM (SELECT *, unnest(range(greatest(length(text) - w + 1, 0)::BIGINT)) AS p FROM recs WHERE text IS NOT NULL)),
      ok AS (SELECT * FROM wins WHERE rec_kind = 'file' OR regexp_full_match(win, '[ACGT]+')),
      several AS (SELECT rec_kind, win FROM ok GROUP BY 1, 2 HAVING count(DISTINCT rec_id) > 1),
      marked AS (SELECT * FROM ok SEMI JOIN several USING (rec_kind, win)),
      gaps AS (SELECT *, CASE WHEN start <= lag(start) OVER (PARTITION BY rec_kind, rec_id ORDER BY start) + w THEN 0 ELSE 1 END AS gap FROM marked),
      runs AS (SELECT *, sum(gap) OVER (PARTITION BY rec_kind, rec_id ORDER BY start) AS run FROM gaps),
      spans AS (SELECT rec_kind, rec_id, min(start)::INTEGER AS span_start, (max(start) - min(start) + w)::INTEGER AS span_len
        FROM runs GROUP BY rec_kind, rec_id, run, w)"""
_NORMAL = "regexp_replace(lower(text), '[^\\p{L}\\p{N}]', '', 'g')"
_LEAKS = f"""docs AS (SELECT doc_id, {_NORMAL} AS t FROM documents),
      items AS (SELECT item_id, {_NORMAL} AS t FROM benchmark),
      win AS (SELECT DISTINCT item_id, substr(t, p, 50) AS s FROM (SELECT item_id, t, unnest(range(1, length(t) - 48)) AS p FROM items)),
      leaks AS (SELECT DISTINCT doc_id, item_id FROM (SELECT doc_id, substr(t, p, 50) AS s FROM
        (SELECT doc_id, t, unnest(range(1, length(t) - 48)) AS p FROM docs)) JOIN win USING (s))"""

_NEAR = """r AS (SELECT read_id, replace(upper(arg_max(read, loaded_at)), 'U', 'T') AS read,
        coalesce(arg_max(struct_pack(o := occ_count), loaded_at).o, 1) AS occ FROM read_counts GROUP BY read_id),
      m AS (SELECT read_id, id_read, position, max(replace(upper(mismatch_char), 'U', 'T')) AS ch FROM mismatches JOIN r USING (read_id)
        WHERE mismatch_char IS NOT NULL AND position >= 0 AND position < length(read) AND id_read >= 0 AND id_read < occ GROUP BY 1, 2, 3),
      letters AS (SELECT o.read_id, o.id_read, p, coalesce(ch, substr(read, p + 1, 1)) AS ch
        FROM (SELECT read_id, id_read, read, unnest(range(length(read))) AS p FROM (SELECT DISTINCT read_id, id_read FROM m) JOIN r USING (read_id)) o
        LEFT JOIN m ON m.read_id = o.read_id AND m.id_read = o.id_read AND m.position = o.p),
      changed AS (SELECT read_id, id_read, string_agg(ch, '' ORDER BY p) AS seq FROM letters GROUP BY 1, 2),
      seqs AS (SELECT DISTINCT read_id, seq FROM (SELECT read_id, seq FROM changed UNION ALL SELECT read_id, read FROM r
        LEFT JOIN (SELECT read_id, count(*) AS n FROM changed GROUP BY 1) USING (read_id) WHERE read IS NOT NULL AND coalesce(n, 0) < occ)),
      ids AS (SELECT row_number() OVER () AS s, * FROM seqs),
      tok AS (SELECT DISTINCT s, read_id, t FROM (SELECT s, read_id, substr(seq, p, 9) AS t FROM
        (SELECT *, unnest(range(1, greatest(length(seq) - 7, 1)::BIGINT)) AS p FROM ids)) WHERE regexp_full_match(t, '[ACGT]{9}')),
      size AS (SELECT s, count(*) AS n FROM tok GROUP BY s),
      near AS (SELECT a.s AS a, b.s AS b, a.read_id AS ra, b.read_id AS rb, count(*) AS c FROM tok a JOIN tok b ON a.t = b.t AND a.read_id < b.read_id GROUP BY ALL)"""

_SEEN = f"""WITH {_INSERTED}, ok AS (SELECT * FROM ins WHERE length(kmer) = k AND regexp_full_match(kmer, '[ACGT]+'))
    SELECT DISTINCT insert_id FROM (SELECT insert_id, min(insert_id) OVER (PARTITION BY graph_id, kmer) AS first FROM ok)
    WHERE insert_id > first"""

ORACLES = {
    "p1_found": f"""WITH {_NEAR} SELECT DISTINCT ra AS read_id_a, rb AS read_id_b FROM near JOIN size x ON x.s = a JOIN size y ON y.s = b
        WHERE 3 * c >= x.n + y.n""",
    "p1_groups": f"""WITH RECURSIVE {_NEAR}, txt AS MATERIALIZED (SELECT seq, -row_number() OVER () AS s FROM (SELECT DISTINCT seq FROM seqs WHERE length(seq) >= 9)),
      mem AS MATERIALIZED (SELECT read_id, s FROM seqs JOIN txt USING (seq)),
      win AS MATERIALIZED (SELECT DISTINCT s, t FROM (SELECT s, substr(seq, p, 9) AS t FROM (SELECT *, unnest(range(1, length(seq) - 7)) AS p FROM txt)) WHERE regexp_full_match(t, '[ACGT]{{9}}')),
      many AS MATERIALIZED (SELECT s, count(*) AS n FROM win GROUP BY 1),
      pair AS MATERIALIZED (SELECT a, b FROM (SELECT x.s AS a, y.s AS b, count(*) AS c FROM win x JOIN win y ON x.t = y.t AND x.s < y.s GROUP BY 1, 2)
        JOIN many x ON x.s = a JOIN many y ON y.s = b WHERE 3 * c >= x.n + y.n),
      link AS MATERIALIZED (SELECT a, b FROM pair UNION ALL SELECT b, a FROM pair),
      way AS MATERIALIZED (SELECT a, b FROM link UNION ALL SELECT read_id, s FROM mem UNION ALL SELECT s, read_id FROM mem),
      cc(node, least) USING KEY (node) AS (SELECT node, node AS least FROM (SELECT read_id AS node FROM r) UNION
        SELECT x.node, x.least FROM (SELECT b AS node, min(least) AS least FROM cc JOIN way ON a = node GROUP BY 1) x
        LEFT JOIN recurring.cc k ON k.node = x.node WHERE k.node IS NULL OR x.least < k.least),
      links AS (SELECT read_id, count(*) AS n FROM mem JOIN link ON a = s GROUP BY 1)
      SELECT r.read_id, cc.least AS group_id, coalesce(links.n, 0) AS n_links FROM r JOIN cc ON node = r.read_id LEFT JOIN links ON links.read_id = r.read_id""",
    "p2_found": f"WITH {_SPANS} SELECT rec_kind, rec_id, span_start, span_len FROM spans",
    "p2_shared_share": f"""WITH {_SPANS}, x AS (SELECT rec_kind, rec_id, sum(span_len) AS shared, count(*) AS n FROM spans GROUP BY 1, 2)
        SELECT rec_kind, rec_id, coalesce(length(text), 0)::INTEGER AS n_chars, coalesce(shared, 0)::BIGINT AS shared_chars, coalesce(n, 0) AS n_spans,
        coalesce(round(shared / length(text), 6), 0) AS share FROM recs LEFT JOIN x USING (rec_kind, rec_id)""",
    "p8_valid": "SELECT doc_id, true AS valid FROM documents WHERE length(text) > 0",
    "p9_found": f"WITH {_LEAKS} SELECT doc_id, item_id FROM leaks",
    "p9_leaked_items": f"WITH {_LEAKS} SELECT item_id, count(*) AS n_docs FROM leaks GROUP BY item_id",
    "p4_found": _SEEN,
    "p4_rate_check": f"""WITH {_INSERTED}, ok AS (SELECT * FROM ins WHERE insert_id IS NOT NULL AND length(kmer) = k AND regexp_full_match(kmer, '[ACGT]+')),
      x AS (SELECT insert_id, bool_or(insert_id > first) AS again FROM (SELECT insert_id, min(insert_id) OVER (PARTITION BY graph_id, kmer) AS first FROM ok) GROUP BY 1)
      SELECT count(*) AS answers, count(*) FILTER (again) AS repeats, 0::BIGINT AS missed, true AS as_stated FROM x""",
    "p5_interval_check": f"""WITH x AS (SELECT DISTINCT graph_id, kmer, day, genome FROM (SELECT i.graph_id, replace(upper(left(array_kmers, k)), 'U', 'T') AS kmer, k,
        inserted_at::DATE AS day, id_genome AS genome FROM kmer_inserts i JOIN meta USING (graph_id)) WHERE length(kmer) = k AND regexp_full_match(kmer, '[ACGT]+')),
      y AS (SELECT graph_id, kmer, 'day' AS kind, day, NULL::INTEGER AS genome, NULL::DATE AS week FROM x
        UNION ALL SELECT graph_id, kmer, 'genome', NULL, genome, NULL FROM x
        UNION ALL SELECT graph_id, kmer, 'week', NULL, NULL, date_trunc('week', day)::DATE FROM x
        UNION ALL SELECT graph_id, kmer, 'genome_week', NULL, genome, date_trunc('week', day)::DATE FROM x
        UNION ALL SELECT graph_id, kmer, 'all', NULL, NULL, NULL FROM x
        UNION ALL SELECT graph_id, kmer, 'day_genome', day, genome, NULL FROM x)
      SELECT kind, coalesce(day::VARCHAR, '-') || '/' || coalesce(genome::VARCHAR, '-') || '/' || coalesce(week::VARCHAR, '-') AS of_day_genome_week,
        count(*) AS n_kmers, true AS within FROM (SELECT DISTINCT * FROM y) GROUP BY 1, 2""",
    "p4_appended": _SEEN,
    "p6_found": f"WITH {_COLOR_SET_ROWS} SELECT annot_hex FROM sets GROUP BY 1 ORDER BY count(*) DESC, annot_hex LIMIT {TOP}",
    "p6_top_color_sets": f"WITH {_COLOR_SET_ROWS} SELECT annot_hex, count(*) AS n_rows FROM sets GROUP BY 1 ORDER BY n_rows DESC, annot_hex LIMIT {TOP}",
    "p7_interval_check": """
        WITH own AS (SELECT DISTINCT graph_id, replace(upper(kmer), 'U', 'T') AS ident, unnest(colors) AS g FROM kmers)
        SELECT a.g AS genome_a, b.g AS genome_b, count(*) AS shared, true AS within FROM own a JOIN own b
        ON a.graph_id = b.graph_id AND a.ident = b.ident AND a.g < b.g GROUP BY 1, 2""",
    "p7_found": """
        WITH own AS (SELECT DISTINCT graph_id, replace(upper(kmer), 'U', 'T') AS ident, unnest(colors) AS g FROM kmers),
        size AS (SELECT g, count(*) AS n FROM own WHERE g IS NOT NULL GROUP BY g),
        both_ AS (SELECT a.g AS a, b.g AS b, count(*) AS n FROM own a JOIN own b
                  ON a.graph_id = b.graph_id AND a.ident = b.ident AND a.g < b.g GROUP BY 1, 2)
        SELECT a AS genome_a, b AS genome_b FROM both_ JOIN size x ON x.g = a JOIN size y ON y.g = b
        WHERE 2 * both_.n >= least(x.n, y.n)""",
}
