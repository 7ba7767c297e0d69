"""One identity per record across feeds: keys, duplicate merge, fills, corrections, upserts, links."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadastra.functions.numbers import day, half_up, ratio
from cadastra.functions.text import blank_to_null, feed_of, norm_area, slugify, tx_key, tx_number
from cadastra.operators.grouping import left_join_keyed, number_rows

TEXT_COLUMNS = (
    "trans_group", "procedure_name", "reg_type", "property_type", "property_sub_type", "property_usage", "area_name",
    "building_name", "project_number", "project_name", "rooms",
)


def with_keys(tx: DataFrame) -> DataFrame:
    """Canonical key per row; null for a number of no known shape."""
    return tx.withColumn("tx_key", tx_key("transaction_id", "trans_group"))


def row_ids(tx: DataFrame, feed: str, order: Sequence[str], stamp: str | None = None) -> DataFrame:
    """Stored ids that stay unique when a feed repeats a number: one running number per repeat."""
    numbered = number_rows(tx.withColumn("_number", tx_number("transaction_id")), ["_number"], order, "_n")
    n = F.col("_n").cast("string")
    forms = {
        "bulk": F.concat("_number", F.lit("#"), n),
        "web": F.concat(F.lit("w#"), "_number", F.lit("#"), n),
        "api": F.concat("_number", F.lit(f"#a{stamp or ''}"), n),
    }
    return numbered.withColumn("stored_id", forms[feed]).drop("_number", "_n")


SIEVE_BITS = 1 << 28


def _sift(rows: DataFrame, hashes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose ``_h`` may be among ``hashes`` (_h), and rows whose ``_h`` is not, without moving a row.

    The hashes set bits of a bitmap of SIEVE_BITS, sent to every task as rows of 64 words of 64 bits: 32 MB at
    most, whatever the table. Where many hashes fill it, more rows are told they may be among them.
    """
    at = F.expr(f"pmod(_h, {SIEVE_BITS}L)")
    bit = F.expr("shiftleft(1L, CAST(_at & 63 AS INT))")
    words = hashes.select(at.alias("_at")).groupBy(F.expr("shiftright(_at, 6)").alias("_word")).agg(F.bit_or(bit).alias("_bits"))
    held = words.groupBy(F.expr("shiftright(_word, 6)").alias("_row")).agg(F.map_from_entries(F.collect_list(F.struct(F.expr("_word & 63L"), "_bits"))).alias("_held"))
    bitmap = held.select("_row", F.expr("transform(sequence(0L, 63L), i -> coalesce(try_element_at(_held, i), 0L))").alias("_words"))
    met = rows.withColumn("_at", at).withColumn("_row", F.expr("shiftright(_at, 12)")).join(F.broadcast(bitmap), "_row", "left")
    met = met.withColumn("_may", F.coalesce((F.expr("get(_words, CAST(shiftright(_at, 6) & 63 AS INT))").bitwiseAND(bit)) != 0, F.lit(False)))
    return met.filter("_may").select(*rows.columns), met.filter("NOT _may").select(*rows.columns)


def merge_duplicates(tx: DataFrame) -> DataFrame:
    """One row per canonical key out of the copies several feeds filed.

    The richest feed's row is kept (bulk, then api, then web, then date); its date becomes the
    web copy's, else the earliest; the amount is the first that carries fils, else the largest;
    other fields take the first copy that states them. First seen is the earliest; withdrawn only
    when every copy is. Rows without a key are kept as they are.

    Most keys are held once, and a lone row keeps its own values. Keys held more often are told by a count of
    their hashes, numbers alone, and a bitmap of these leaves most lone rows where they are; only the rest is shuffled to
    meet the hashes. Only rows of keys held more often are merged, all fields in one aggregate of minima and
    maxima, so copies combine before the shuffle and a key with any number of copies stays one row per
    task. (Two keys of one hash only send lone rows through the merge, which leaves them as they are.)
    """
    feed = feed_of("transaction_id")
    web = feed == "web"
    rank = F.when(feed == "bulk", F.lit(0)).when(feed == "api", F.lit(1)).otherwise(F.lit(2))
    order = F.struct(
        rank.alias("r"), "instance_date", "transaction_id", "actual_worth", "procedure_area", "meter_sale_price", "project_number", "area_name", "building_name"
    )
    keyed = tx.filter(F.col("tx_key").isNotNull()).withColumn("_h", F.xxhash64("tx_key"))
    often = keyed.groupBy("_h").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1).select("_h")
    moved, still = _sift(keyed, often)
    copies, lone = moved.join(often, "_h", "left_semi"), moved.join(often, "_h", "left_anti").unionByName(still)
    rows = copies.select("*", order.alias("_o"), web.alias("_web"), *[blank_to_null(c).alias(f"_t_{c}") for c in TEXT_COLUMNS])
    fils = F.abs(F.col("actual_worth") - F.round("actual_worth")) > 1e-9
    first = lambda c, cond=None: F.min_by(c, F.when(F.col(c).isNotNull() if cond is None else cond, F.col("_o")))
    merged = rows.groupBy("tx_key").agg(
        F.count(F.lit(1)).alias("copies"),
        F.min("_o").alias("_kept"),
        F.coalesce(F.min_by("instance_date", F.when(F.col("_web"), F.col("_o"))), F.min("instance_date")).alias("instance_date"),
        F.min(F.when(~F.col("_web"), F.col("instance_date"))).alias("feed_date"),
        F.coalesce(first("actual_worth", fils), F.max("actual_worth")).alias("actual_worth"),
        first("procedure_area").alias("procedure_area"),
        first("meter_sale_price").alias("_psm"),
        F.min("first_seen").alias("first_seen"),
        F.when(F.count("withdrawn_on") == F.count(F.lit(1)), F.min("withdrawn_on")).alias("withdrawn_on"),
        *[first(f"_t_{c}").alias(c) for c in TEXT_COLUMNS],
    )
    priced = (F.col("copies") > 1) & F.col("actual_worth").isNotNull() & (F.col("procedure_area") != 0)
    out = merged.select(
        "tx_key", "copies", F.col("_kept.transaction_id").alias("transaction_id"), "instance_date", "feed_date", "actual_worth", "procedure_area", "first_seen",
        "withdrawn_on", *TEXT_COLUMNS, F.when(priced, half_up(ratio("actual_worth", "procedure_area"))).otherwise(F.col("_psm")).alias("meter_sale_price"),
    )
    one = F.lit(1).cast("bigint").alias("copies")
    lone = lone.select(
        "tx_key", one, "transaction_id", "instance_date", F.when(~web, F.col("instance_date")).alias("feed_date"), "actual_worth", "procedure_area", "first_seen",
        "withdrawn_on", *[blank_to_null(c).alias(c) for c in TEXT_COLUMNS], "meter_sale_price")
    unkeyed = tx.filter(F.col("tx_key").isNull()).select("*", one)
    return out.unionByName(lone).unionByName(unkeyed.select(*out.columns))


def merge_summary(tx: DataFrame) -> DataFrame:
    """How much the merge would change: keys held more than once, rows removed, keys in both shapes."""
    keyed = tx.filter(F.col("tx_key").isNotNull()).groupBy("tx_key").agg(
        F.count(F.lit(1)).alias("n"), F.max((feed_of("transaction_id") == "web").cast("int")).alias("w"),
        F.min((feed_of("transaction_id") == "web").cast("int")).alias("b"), F.min(F.size(F.split("transaction_id", "-"))).alias("s3"),
        F.max(F.size(F.split("transaction_id", "-"))).alias("s4"),
    )
    return keyed.agg(
        F.count(F.lit(1)).alias("keys"), F.count_if(F.col("n") > 1).alias("held_twice"),
        F.sum(F.col("n") - 1).alias("rows_removed"), F.count_if((F.col("s3") == 3) & (F.col("s4") == 4)).alias("in_both_shapes"),
    )


def fill_blanks(held: DataFrame, feed: DataFrame, key: str, columns: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Held rows gain what a richer feed states and they leave blank; a held value always wins."""
    offered = feed.filter(F.col(key).isNotNull()).groupBy(key).agg(
        *[F.min_by(c, F.when(F.col(c).isNotNull(), F.struct(*order))).alias(f"_f_{c}") for c in columns]
    )
    joined = left_join_keyed(held, offered, key)
    return joined.select(
        *[F.coalesce(c, f"_f_{c}").alias(c) if c in columns else F.col(c) for c in held.columns]
    )


def correct_from_register(held: DataFrame, web: DataFrame, order: Sequence[str]) -> DataFrame:
    """The register's own screen corrects date and amount of held rows; the old date stays as feed date."""
    newest = web.filter(F.col("tx_key").isNotNull()).groupBy("tx_key").agg(
        F.max_by(F.struct("instance_date", "actual_worth", "procedure_area"), F.struct(*order)).alias("_w")
    )
    joined = left_join_keyed(held, newest, "tx_key")
    hit = F.col("_w").isNotNull()
    worth = F.coalesce("_w.actual_worth", "actual_worth")
    area = F.coalesce("_w.procedure_area", "procedure_area")
    new = {
        "instance_date": F.coalesce("_w.instance_date", "instance_date"),
        "actual_worth": worth,
        "feed_date": F.when(hit, F.coalesce("feed_date", "instance_date")).otherwise(F.col("feed_date")),
        "meter_sale_price": F.when(hit, half_up(ratio(worth, area), 2)).otherwise(F.col("meter_sale_price")),
    }
    return joined.select(*[new[c].alias(c) if c in new else F.col(c) for c in held.columns])


def append_new(store: DataFrame, batch: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The rows of a batch whose key is new, one per key; rows with a null key are always new."""
    null_key = F.lit(False)
    for k in key:
        null_key = null_key | F.col(k).isNull()
    keyed = batch.filter(~null_key)
    first = Window.partitionBy(*key).orderBy(*order)
    once = keyed.withColumn("_rn", F.row_number().over(first)).filter(F.col("_rn") == 1).drop("_rn")
    return once.join(store.select(*key), list(key), "left_anti").select(*batch.columns).unionByName(batch.filter(null_key))


def upsert(
    store: DataFrame, batch: DataFrame, key: Sequence[str], overwrite: Sequence[str], keep_if_null: Sequence[str] = (), order: Sequence[str] = ()
) -> DataFrame:
    """Store after a batch: some columns are overwritten, some only when the new value is stated.

    Columns of the store in neither list keep their stored value for known keys. Of several batch rows of
    one key the last by ``order`` counts, then the last by all its columns; each row without a key is one of its own.
    """
    ranked = F.struct(*[F.col(c) for c in (*order, *[c for c in batch.columns if c not in order])])
    keyless = F.greatest(*[F.col(k).isNull() for k in key], F.lit(False))
    last = batch.filter(~keyless).groupBy(*[F.col(k).alias(f"_k_{k}") for k in key]).agg(F.max(ranked).alias("_last"))
    batch = last.select(*[F.col(f"_last.{c}").alias(c) for c in batch.columns]).unionByName(batch.filter(keyless))
    new = batch.select(*key, F.lit(True).alias("_new"), *[F.col(c).alias(f"_n_{c}") for c in batch.columns if c not in key])
    old = store.withColumn("_old", F.lit(True))
    joined = old.join(new, list(key), "full_outer")
    known, arriving = F.col("_old").isNotNull(), F.col("_new").isNotNull()

    def settled(c: str) -> Column:
        if c in key:
            return F.col(c)
        if f"_n_{c}" not in joined.columns:
            return F.col(c)
        if c in overwrite:
            return F.when(arriving, F.col(f"_n_{c}")).otherwise(F.col(c))
        if c in keep_if_null:
            return F.coalesce(f"_n_{c}", c)
        return F.when(known, F.col(c)).otherwise(F.col(f"_n_{c}"))

    return joined.select(*[settled(c).alias(c) for c in store.columns])


def link_by_name(df: DataFrame, project: DataFrame, trim: bool = True) -> DataFrame:
    """Fill a missing project number by name, ignoring case; of several matches the lowest number."""
    fold = lambda c: F.upper(F.trim(F.col(c))) if trim else F.upper(F.col(c))
    names = project.groupBy(fold("project_name").alias("_name")).agg(F.min("project_number").alias("_linked"))
    joined = left_join_keyed(df.withColumn("_name", F.when(F.col("project_number").isNull(), fold("project_name"))), names.filter(F.col("_name").isNotNull()), "_name")
    return joined.select(*[F.coalesce(c, "_linked").alias(c) if c == "project_number" else F.col(c) for c in df.columns])


def map_area(df: DataFrame, project: DataFrame, known_areas: DataFrame) -> DataFrame:
    """Registry area of a website row: linked project's, else a known name, else the community's usual area.

    ``mapped`` is false where none applies and the name is only title-cased.
    """
    by_community = (
        project.filter(blank_to_null("master_project").isNotNull())
        .groupBy(F.lower(F.trim("master_project")).alias("_text"), "area_name")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("_text")
        .agg(F.max_by("area_name", F.struct("n", "area_name")).alias("_community"))
    )
    names = known_areas.groupBy(F.lower("area_name").alias("_text")).agg(F.min("area_name").alias("_known"))
    linked = project.select("project_number", F.col("area_name").alias("_linked"))
    # Rows without a project would all meet in one task of a plain join.
    with_project = left_join_keyed(df.withColumn("_text", F.lower(F.trim("area_text"))), linked, "project_number")
    joined = with_project.join(names, "_text", "left").join(by_community, "_text", "left")
    hit = F.coalesce("_linked", "_known", "_community")
    return joined.select(
        *df.columns, F.coalesce(hit, norm_area("area_text")).alias("mapped_area"), hit.isNotNull().alias("mapped")
    )


def disambiguate_slug(df: DataFrame, scope: str, slug: str, key: str) -> DataFrame:
    """Unique slug in its scope: the first key keeps it, later ones carry their key.

    The first key is a grouped minimum joined back, so a slug shared by many rows is not gathered.
    """
    owner = df.groupBy(scope, slug).agg(F.min(key).alias("_owner"))
    return df.join(owner, [scope, slug]).select(
        *[F.when(F.col(key) == F.col("_owner"), F.col(slug)).otherwise(F.concat_ws("-", slug, key)).alias(slug) if c == slug else F.col(c)
          for c in df.columns]
    )


def match_snapshot(snapshot: DataFrame, project: DataFrame) -> DataFrame:
    """Project of each snapshot row: by key where it carries a known one, else by name in the same area first."""
    known = project.select(F.col("project_number").alias("_pn"))
    keyed = snapshot.filter(F.col("key").isNotNull()).join(known, F.col("key") == F.col("_pn"), "left").withColumn("matched", F.col("_pn"))
    names = project.groupBy(F.lower(F.trim("project_name")).alias("_name")).agg(F.min("project_number").alias("_any"))
    in_area = project.groupBy(F.lower(F.trim("project_name")).alias("_name"), F.lower("area_name").alias("_area")).agg(
        F.min("project_number").alias("_same")
    )
    unkeyed = (
        snapshot.filter(F.col("key").isNull())
        .withColumn("_name", F.lower("name")).withColumn("_area", F.lower("area"))
        .join(names, "_name", "left").join(in_area, ["_name", "_area"], "left")
        .withColumn("matched", F.coalesce("_same", "_any"))
    )
    return keyed.select(*snapshot.columns, "matched").unionByName(unkeyed.select(*snapshot.columns, "matched"))


def trigrams(text: Column) -> Column:
    """The distinct runs of three characters of a text; none of a shorter one."""
    every = F.transform(F.sequence(F.lit(1), F.length(text) - 2), lambda k: F.substring(text, k, F.lit(3)))
    return F.when(F.length(text) >= 3, F.array_distinct(every)).otherwise(F.array().cast("array<string>"))


def containing(asked: DataFrame, held: DataFrame, scope: str, word: str, texts: Sequence[str], found: Column) -> DataFrame:
    """(scope, word, _found): least ``found`` of the held rows of the scope whose texts contain the word, of three letters at least.

    Held texts are posted under each of their trigrams. A word is looked up under the rarest of its own in its
    scope only, so it meets the texts that could hold it instead of all of the scope's.
    """
    postings = held.withColumn("_gram", F.explode(F.array_union(*[trigrams(F.col(t)) for t in texts])) if len(texts) == 2 else F.explode(trigrams(F.col(texts[0]))))
    counts = postings.groupBy(scope, "_gram").agg(F.count(F.lit(1)).alias("_n"))
    own = asked.select(scope, word).distinct().withColumn("_grams", trigrams(F.col(word)))
    rarest = (
        own.select(scope, word, F.size("_grams").alias("_k"), F.explode("_grams").alias("_gram")).join(counts, [scope, "_gram"])
        .groupBy(scope, word, "_k").agg(F.count(F.lit(1)).alias("_met"), F.min(F.struct("_n", "_gram")).alias("_least"))
        .filter(F.col("_met") == F.col("_k"))  # a trigram that no text has settles it
        .select(scope, word, F.col("_least._gram").alias("_gram"))
    )
    holds = F.lit(False)
    for t in texts:
        holds = holds | F.col(t).contains(F.col(word))
    return rarest.join(postings, [scope, "_gram"]).filter(holds).groupBy(scope, word).agg(F.min(found).alias("_found"))


def resolve_listings(listings: DataFrame, project: DataFrame) -> DataFrame:
    """Project of a listing: exact name or slug, else its first telling word inside the same area, else none."""
    name = F.coalesce(blank_to_null("project_name"), blank_to_null("building_name"), F.lit(""))
    rows = listings.withColumn("_name", name).withColumn("_slug", slugify("_name")).withColumn("_area", slugify("area_name"))
    exact = (
        project.select("project_number", F.explode(F.array("project_name", "slug")).alias("_text"))
        .groupBy("_text").agg(F.min("project_number").alias("pn"))
    )
    words = F.filter(F.split("_slug", "-"), lambda w: (F.length(w) > 2) & (w != "the"))
    by_name = exact.select(F.col("_text").alias("_name"), F.col("pn").alias("_by_name"))
    by_slug = exact.select(F.col("_text").alias("_slug"), F.col("pn").alias("_by_slug"))
    looked = rows.join(by_name, "_name", "left").join(by_slug, "_slug", "left").withColumn("_exact", F.coalesce("_by_name", "_by_slug"))
    looked = looked.withColumn("_word", F.when(F.col("_exact").isNull(), F.get(words, F.lit(0))))
    asked = looked.filter(F.col("_word").isNotNull()).select("_area", "_word")
    held = project.select(F.col("area_slug").alias("_area"), "project_number", F.lower("project_name").alias("_pname"), F.col("slug").alias("_pslug"))
    fuzzy = containing(asked, held, "_area", "_word", ["_pname", "_pslug"], F.col("project_number")).withColumnRenamed("_found", "_fuzzy")
    out = looked.join(fuzzy, ["_area", "_word"], "left")
    exact_hit, fuzzy_hit = F.col("_exact").isNotNull(), F.col("_fuzzy").isNotNull()
    return out.select(
        *listings.columns, F.coalesce("_exact", "_fuzzy").alias("project_number"),
        F.when(exact_hit, F.lit(1.0)).when(fuzzy_hit, F.lit(0.6)).otherwise(F.lit(0.0)).alias("confidence"),
        F.when(exact_hit, F.lit("exact-name")).when(fuzzy_hit, F.lit("fuzzy-area-prefix")).otherwise(F.lit("unresolved")).alias("method"),
    )


def merge_windows(rows: DataFrame, key: str, window: str, columns: Sequence[str]) -> DataFrame:
    """Overlapping query windows merged per key: the later window wins field by field, all windows listed."""
    return rows.groupBy(key).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(window))).alias(c) for c in columns],
        F.array_sort(F.collect_set(window)).alias("windows"),
    )


def short_windows(rows: DataFrame, key: str, window: str, total: str, at_least: float = 0.9) -> DataFrame:
    """Distinct keys each window returned against the total it stated."""
    # Distinct through grouping first, so one large window is counted by many tasks.
    distinct = rows.groupBy(window, key).agg(F.max(total).alias("_t"))
    return distinct.groupBy(window).agg(F.count(F.lit(1)).alias("rows"), F.max("_t").alias("stated")).withColumn(
        "short", F.col("rows") < F.col("stated") * at_least
    )


def versioned_series(df: DataFrame, key: Sequence[str], values: Sequence[str], version: str) -> DataFrame:
    """Every version of a restated series; exact repeats dropped and counted per row kept."""
    return df.groupBy(*key, version, *values).agg((F.count(F.lit(1)) - 1).alias("exact_repeats"))


def version_conflicts(df: DataFrame, key: Sequence[str], values: Sequence[str], version: str) -> DataFrame:
    """Same key and version carrying different figures: unorderable, so a load must stop on any."""
    return df.groupBy(*key, version).agg(F.count_distinct(F.struct(*values)).alias("figures")).filter(F.col("figures") > 1)


def absent_months(df: DataFrame, month: str) -> DataFrame:
    """Months missing between the first and the last one held."""
    span = df.agg(F.min(month).alias("a"), F.max(month).alias("b"))
    spine = span.select(F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias(month))
    return spine.join(df.select(month).distinct(), month, "left_anti")


def replace_source(obs: DataFrame, source: str, fresh: DataFrame) -> DataFrame:
    """Drop one source's readings and put its re-dated readings in their place."""
    return obs.filter(~F.col("source").eqNullSafe(F.lit(source))).unionByName(fresh.select(*obs.columns))


def apply_alias(df: DataFrame, column: str, alias: Mapping[str, str], name: str) -> DataFrame:
    """Common name of a registry name where one is known; the dictionary is a fixed small map."""
    table = F.create_map(*[F.lit(x) for pair in alias.items() for x in pair]) if alias else F.create_map()
    return df.withColumn(name, F.coalesce(F.try_element_at(table, F.col(column)), F.col(column)))


# Communities as listings name them, and the register's areas.
COMMUNITY_AREAS = {
    "The Meadows": "Al Thanayah Fourth", "The Springs": "Al Thanayah Fourth", "The Lakes": "Al Thanayah Fourth", "Arabian Ranches": "Wadi Al Safa 6",
    "Arabian Ranches 2": "Wadi Al Safa 7", "Arabian Ranches 3": "Wadi Al Safa 5", "Tilal Al Ghaf": "Al Hebiah Fourth", "Dubai Marina": "Marsa Dubai",
    "Downtown Dubai": "Burj Khalifa", "Jumeirah Village Circle (JVC)": "Al Barsha South Fourth", "Jumeirah Lake Towers (JLT)": "Al Thanyah Fifth",
    "Dubai Hills Estate": "Hadaeq Sheikh Mohammed Bin Rashid", "Palm Jumeirah": "Palm Jumeirah",
}
# Sub-communities that the register names by a pattern of its own.
PROJECT_PATTERNS = ((r"(?i)^The Springs (\d+)$", "Emirates Living - Springs $1"),)


def adapt_listings(listings: DataFrame, areas: Mapping[str, str] = COMMUNITY_AREAS, patterns: Sequence[tuple[str, str]] = PROJECT_PATTERNS) -> DataFrame:
    """Listings (community, sub_community) under the register's names: area_name and project_name.

    A community without a register name of its own stays as it is. A sub-community names a project, by the register's pattern
    where it has one; one that only repeats its community names none.
    """
    community, sub = F.trim(F.coalesce("community", F.lit(""))), F.trim(F.coalesce("sub_community", F.lit("")))
    named = F.when((sub != "") & (F.lower(sub) != F.lower(community)), sub).otherwise(F.lit(""))
    for pattern, name in reversed(list(patterns)):
        named = F.when(sub.rlike(pattern), F.regexp_replace(sub, pattern, name)).otherwise(named)
    return apply_alias(listings.withColumn("_community", community), "_community", areas, "area_name").drop("_community").withColumn("project_name", named)


# ---- vintages: when our copy first held a row, and when the register dropped it ----

def vintage_sweep(rows: DataFrame, vintage: DataFrame, kind: str, run_date: str, baseline_taken: bool, baseline: Column | None = None) -> DataFrame:
    """Vintage rows to append: the first run stamps a baseline, later runs stamp what is new with the run date."""
    stamp = day(run_date) if baseline_taken else (F.lit("1970-01-01").cast("date") if baseline is None else baseline)
    known = vintage.filter(F.col("kind") == kind).select("id")
    fresh = rows.filter(F.col("id").isNotNull()).join(known, "id", "left_anti")
    return fresh.groupBy("id").agg(F.min(stamp).alias("first_seen")).select(
        F.lit(kind).alias("kind"), "id", "first_seen", F.lit(None).cast("date").alias("withdrawn_on")
    )


def first_seen_entities(store: DataFrame, batch: DataFrame, key: str, kind: str, run_date: str) -> DataFrame:
    """Vintage of entities a batch adds, only if the store held anything before it."""
    held = store.agg(F.count(F.lit(1)).alias("n")).scalar()
    fresh = batch.select(key).distinct().join(store.select(key), key, "left_anti").filter(held > 0)
    return fresh.select(F.lit(kind).alias("kind"), F.col(key).alias("id"), day(run_date).alias("first_seen"))


def withdrawal_marks(
    held: DataFrame, returned: DataFrame, day_marks: DataFrame, run_date: str, min_age: int = 3, min_share: float = 0.9
) -> DataFrame:
    """Per held row of a checked feed day: withdrawn when its key was not returned, cleared when it was.

    A day is checked when it came back complete, is old enough and returned enough of what is held.
    """
    counts = held.groupBy("feed_date").agg(F.count(F.lit(1)).alias("held_rows"))
    old = F.col("feed_date") <= F.date_sub(day(run_date), min_age)
    checked = (
        day_marks.filter(F.col("ok") & old).join(counts, "feed_date")
        .filter(F.col("returned_rows") >= F.col("held_rows") * F.lit(min_share)).select("feed_date")
    )
    keys = returned.select("feed_date", "tx_key").distinct().withColumn("_back", F.lit(True))
    rows = held.join(checked, "feed_date", "left_semi").join(keys, ["feed_date", "tx_key"], "left")
    return rows.select(
        "transaction_id", "feed_date", "tx_key",
        F.when(F.col("_back").isNotNull(), F.lit("present")).otherwise(F.lit("withdrawn")).alias("mark"),
        F.when(F.col("_back").isNull(), day(run_date)).alias("withdrawn_on"),
    )


def withdrawal_days(held: DataFrame, day_marks: DataFrame, run_date: str, min_age: int = 3, min_share: float = 0.9) -> DataFrame:
    """Why each day was or was not checked."""
    counts = held.groupBy("feed_date").agg(F.count(F.lit(1)).alias("held_rows"))
    joined = day_marks.join(counts, "feed_date", "left")
    outcome = (
        F.when(~F.col("ok"), F.lit("incomplete")).when(F.col("feed_date") > F.date_sub(day(run_date), min_age), F.lit("too recent"))
        .when(F.col("held_rows").isNull(), F.lit("nothing held"))
        .when(F.col("returned_rows") < F.col("held_rows") * F.lit(min_share), F.lit("thin")).otherwise(F.lit("checked"))
    )
    return joined.withColumn("outcome", outcome)


def run_log(run_date: str, counts: Mapping[str, DataFrame], notes: str = "") -> DataFrame:
    """One row per refresh: a counter for each table handed in, and notes."""
    columns = [df.agg(F.count(F.lit(1)).alias("n")).scalar().alias(name) for name, df in counts.items()]
    spark = next(iter(counts.values())).sparkSession
    return spark.range(1).select(day(run_date).alias("run_date"), *columns, F.lit(notes).alias("notes"))
