"""Contact dedupe: standardise, block, score, cluster, and merge into golden records with provenance."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import contacts as n
from millrace.functions.numbers import half_up, histogram_bin
from millrace.operators.graph import components

# Fixed values.
WEIGHTS = {"email": 0.30, "phone": 0.20, "first": 0.15, "last": 0.20, "company": 0.15}
HEADERS = (
    ("id", r"^(record|contact|row|hs_object|crm)?[\s_-]*id$"),
    ("first", r"^(first|given|fore|vor)[\s_-]*name$|^first$|^vorname$"),
    ("last", r"^(last|sur|family|nach)[\s_-]*name$|^surname$|^last$|^nachname$"),
    ("full", r"^(full|contact|display)?[\s_-]*name$"),
    ("email", r"e-?mail"),
    ("phone", r"phone|mobile|tel|telefon|handy"),
    ("company", r"company|organi[sz]ation|account|firma|employer"),
    ("country", r"country|^land$|nation"),
    ("title", r"title|job|position|role"),
    ("lifecycle", r"lifecycle|stage|status"),
    ("last_activity", r"last[\s_-]*(activity|contact|engagement|touch|modified|seen)|updated|modified"),
)
FIELDS = ("first", "last", "email", "phone", "company", "country", "title", "stage", "date")
VOLATILE = ("email", "phone", "company", "title", "seniority", "fn", "country")
STABLE = ("first", "last")
GOLDEN = ("first", "last", "email", "phone", "company", "country", "title", "seniority", "fn", "stage", "date")
PARTS = 64  # of a block while its rows are counted
SWITCHES = ("names", "email", "phone", "company", "country", "title", "stage")


def detect_columns(headers: list[str]) -> dict[str, str]:
    """Field to header: each field, in the order of HEADERS, gets the first header that fits and has no field yet."""
    field_of: dict[str, str] = {}
    for name, pattern in HEADERS:
        fitting = [h for h in headers if h not in field_of and re.search(pattern, h.lower().strip())]
        field_of.update({h: name for h in fitting[:1]})
    return {name: h for h, name in field_of.items()}


def standardise(rows: DataFrame, mapping: dict[str, str], row_col: str, default_country: str = "DE", off: tuple[str, ...] = ()) -> DataFrame:
    """One row a contact: row, id, cleaned fields, raw_<field>, extra (unmapped columns), and match keys in `k`.

    Switches in `off` (of SWITCHES) leave their fields as they are. Null fields count as empty. Contacts are dealt anew by
    their number into spark.sql.shuffle.partitions: they may come in few files, and cleaning a row takes far longer than
    reading it, so that its bytes do not tell how many tasks it takes.
    """
    rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), row_col)
    on = {s: s not in off for s in SWITCHES}
    raw = {f: F.coalesce(F.col(mapping[f]).cast("string"), F.lit("")) if f in mapping else F.lit("") for f, _ in HEADERS}
    extra = [c for c in rows.columns if c not in mapping.values() and c != row_col]
    base = rows.select(
        F.col(row_col).alias("row"),
        F.when(n.collapse(raw["id"]) != "", n.collapse(raw["id"])).otherwise(F.concat(F.lit("row-"), F.col(row_col).cast("string"))).alias("id"),
        *[raw[f].alias(f"raw_{f}") for f, _ in HEADERS if f != "id"],
        (F.create_map(*[x for c in extra for x in (F.lit(c), F.coalesce(F.col(c).cast("string"), F.lit("")))]) if extra else F.create_map().cast("map<string,string>")).alias("extra"),
    )
    c = lambda f: F.col(f"raw_{f}")
    both_empty = (n.collapse(c("first")) == "") & (n.collapse(c("last")) == "") & (n.collapse(c("full")) != "")
    iso = n.country(c("country")) if on["country"] else F.lit("")
    base = base.withColumn("iso", iso).withColumn("ctx", F.when(F.col("iso") != "", F.col("iso")).otherwise(default_country)).withColumn("split", n.split_full(c("full")))
    first = F.when(both_empty, F.col("split.first")).otherwise(c("first"))
    last = F.when(both_empty, F.col("split.last")).otherwise(c("last"))
    out = base.select(
        "*",
        (n.name_case(n.without_honorifics(first)) if on["names"] else c("first")).alias("first"),
        (n.name_case(last) if on["names"] else c("last")).alias("last"),
        n.email(c("email")).alias("em"),
        n.phone(c("phone"), F.col("ctx")).alias("ph"),
        (n.company(c("company")) if on["company"] else c("company")).alias("company"),
        (F.when(F.col("iso") != "", F.col("iso")).otherwise(n.collapse(c("country"))) if on["country"] else c("country")).alias("country"),
        (n.title(c("title")) if on["title"] else c("title")).alias("title"),
        (n.stage(c("lifecycle")) if on["stage"] else c("lifecycle")).alias("stage"),
        (n.stage_rank(c("lifecycle")) if on["stage"] else F.lit(-1)).alias("stage_rank"),
    )
    date = n.date(c("last_activity"), F.col("ctx"))
    blank = F.lit("")
    out = out.select(
        "*",
        (F.col("em.value") if on["email"] else c("email")).alias("email"),
        (F.col("em.valid") if on["email"] else F.lit(True)).alias("email_valid"),
        (F.col("ph.value") if on["phone"] else c("phone")).alias("phone"),
        (F.col("ph.ok") if on["phone"] else F.lit(True)).alias("phone_ok"),
        (F.when(date != "", date).otherwise(n.collapse(c("last_activity"))) if on["stage"] else c("last_activity")).alias("date"),
        (n.seniority(F.col("title")) if on["title"] else blank).alias("seniority"),
        (n.job_function(F.col("title")) if on["title"] else blank).alias("fn"),
    )
    first_key = n.letters(F.substring_index("first", " ", 1)) if on["names"] else F.trim("first")
    last_key = n.letters(F.col("last")) if on["names"] else F.trim("last")
    out = out.withColumn("k_first", n.canonical_name(first_key)).withColumn("k_last", last_key).withColumn("k_last_c", n.canonical_name(last_key))
    key = F.struct(
        (F.col("em.key") if on["email"] else F.trim(c("email"))).alias("email"),
        F.when(F.col("phone").rlike(r"^\+\d{8,}$"), F.col("phone")).otherwise("").alias("phone"),
        F.col("k_first").alias("first"),
        F.col("k_last").alias("last"),
        F.col("k_last_c").alias("last_c"),
        n.company_tokens(F.col("company")).alias("co"),
        n.cologne(F.col("k_first")).alias("pf"),
        n.cologne(F.col("k_last_c")).alias("pl"),
        n.free_mail(F.col("em.key")).alias("free_mail"),
    )
    return out.withColumn("k", key).drop("em", "ph", "split", "iso", "ctx", "k_first", "k_last", "k_last_c")


def change_log(std: DataFrame) -> DataFrame:
    """(row, id, field, before, after) of every cleaned field that changed."""
    raw = {"stage": "lifecycle", "date": "last_activity"}
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"raw_{raw.get(f, f)}").alias("before"), F.col(f).alias("after")) for f in FIELDS])
    return std.select("row", "id", F.inline(pairs)).filter("before <> after")


def change_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("field").agg(F.count("*").alias("changes"))


def blocking_keys(std: DataFrame) -> DataFrame:
    """(row, kind, key): email, phone, sorted phonetic name pair, and that with the company."""
    pair = F.array_join(F.array_sort(F.array("k.pf", "k.pl")), "|")
    named = (F.col("k.pf") != "") & (F.col("k.pl") != "")
    co = F.array_join("k.co", " ")
    kinds = [
        (F.col("k.email") != "", 0, "email", F.concat(F.lit("e:"), "k.email")),
        (F.col("k.phone") != "", 1, "phone", F.concat(F.lit("p:"), "k.phone")),
        (named & (co != ""), 2, "company", F.concat(F.lit("c:"), co, F.lit("#"), pair)),
        (named, 3, "name", F.concat(F.lit("n:"), pair)),
    ]
    entries = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(o).alias("kind_order"), F.lit(k).alias("kind"), v.alias("key"))) for c, o, k, v in kinds]))
    return std.select("row", F.inline(entries))


def block_sizes(keys: DataFrame, max_block: int = 40) -> DataFrame:
    """(key, kind, rows, first_row, kept): blocks of two to max_block rows are kept, larger ones are skipped: they name
    shared switchboards and common names, and the limit is what a block means here."""
    return keys.groupBy("key", "kind", "kind_order").agg(F.count("*").alias("rows"), F.min("row").alias("first_row")).withColumn("kept", F.col("rows").between(2, max_block))


def candidate_pairs(keys: DataFrame, max_block: int = 40) -> DataFrame:
    """(a, b, via, reason): distinct pairs a < b of the kept blocks, the kinds of block they share, and the kind of the
    block that was created first. Keys are read once; a block's rows meet by parts, so that no task holds a large one."""
    part = F.pmod(F.xxhash64("row"), F.lit(PARTS)).alias("part")
    # One row more than a kept block has is enough of a part: its block is skipped.
    some = F.slice(F.collect_list("row"), 1, max_block + 1).alias("some")
    parts = keys.groupBy("key", "kind", "kind_order", part).agg(F.count("*").alias("n"), some)
    blocks = (
        parts.groupBy("key", "kind", "kind_order")
        .agg(F.sum("n").alias("n"), F.array_sort(F.flatten(F.collect_list("some"))).alias("rows"))
        .filter(F.col("n").between(2, max_block))
    )
    later = lambda x, i: F.transform(F.slice("rows", i + 2, F.size("rows")), lambda y: F.struct(x.alias("a"), y.alias("b")))
    return (
        blocks.select("kind", F.struct(F.get("rows", F.lit(0)), "kind_order").alias("created"), F.inline(F.flatten(F.transform("rows", later))))
        .filter("a < b")
        .groupBy("a", "b")
        .agg(F.array_sort(F.collect_set("kind")).alias("via"), F.min_by("kind", "created").alias("reason"))
    )


def pair_space(std: DataFrame, pairs: DataFrame) -> DataFrame:
    """(all_pairs, candidates)."""
    all_pairs = std.agg((F.count("*") * (F.count("*") - 1) / 2).cast("long").alias("all_pairs"))
    return all_pairs.join(pairs.agg(F.count("*").alias("candidates")))


def score_pairs(pairs: DataFrame, std: DataFrame) -> DataFrame:
    """(a, b, s, signals, swapped, ...): the weighted score over the features both rows have."""
    left = std.select(F.col("row").alias("a"), F.col("k").alias("ka"))
    right = std.select(F.col("row").alias("b"), F.col("k").alias("kb"))
    rows = pairs.join(left, "a").join(right, "b")
    rows = rows.select(
        "a", "b", "via", "ka", "kb",
        n.jaro_winkler("ka.first", "kb.first").alias("ff"), n.jaro_winkler("ka.last", "kb.last").alias("ll"),
        n.jaro_winkler("ka.first", "kb.last_c").alias("fl"), n.jaro_winkler("ka.last_c", "kb.first").alias("lf"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    swapped = zero("fl") * WEIGHTS["first"] + zero("lf") * WEIGHTS["last"] > zero("ff") * WEIGHTS["first"] + zero("ll") * WEIGHTS["last"] + 0.05
    equal = lambda f: F.when((F.col(f"ka.{f}") != "") & (F.col(f"kb.{f}") != ""), (F.col(f"ka.{f}") == F.col(f"kb.{f}")).cast("double"))
    jaccard = F.when(
        (F.size("ka.co") > 0) & (F.size("kb.co") > 0), F.size(F.array_intersect("ka.co", "kb.co")) / F.size(F.array_union("ka.co", "kb.co"))
    )
    rows = rows.withColumn("swapped", swapped).select(
        "a", "b", "via", "swapped",
        equal("email").alias("f_email"), equal("phone").alias("f_phone"),
        F.when(F.col("swapped"), F.col("fl")).otherwise(F.col("ff")).alias("f_first"),
        F.when(F.col("swapped"), F.col("lf")).otherwise(F.col("ll")).alias("f_last"),
        jaccard.alias("f_company"),
    )
    top, weight = F.lit(0.0), F.lit(0.0)
    for f, w in WEIGHTS.items():
        # A differing email is weak evidence: people keep several.
        own = F.when(F.col("f_email") == 0, w / 2).otherwise(w) if f == "email" else F.lit(w)
        has = F.col(f"f_{f}").isNotNull()
        top = top + F.when(has, own * F.col(f"f_{f}")).otherwise(0.0)
        weight = weight + F.when(has, own).otherwise(0.0)
    s = F.when(weight > 0, top / weight).otherwise(0.0)
    alone = F.col("f_email").isNull() & F.col("f_phone").isNull() & F.col("f_company").isNull()
    s = s * F.when(alone, 0.75).otherwise(1.0) * F.when(F.col("f_first") < 0.75, 0.8).otherwise(1.0)
    near = lambda f: F.coalesce(F.col(f) >= 0.92, F.lit(False))
    signals = F.array_compact(
        F.array(
            F.when(F.col("f_email") == 1, "email"),
            F.when(F.col("f_phone") == 1, "phone"),
            F.when(near("f_first") & near("f_last"), F.when(F.col("swapped"), "name (swapped)").otherwise("name")).when(near("f_last"), "last name"),
            F.when(F.col("f_company") >= 0.5, "company"),
        )
    )
    return rows.withColumn("s", half_up(F.round(s, 9), 3)).withColumn("signals", signals)


def bands(scored: DataFrame, auto: float = 0.8, review: float = 0.6) -> DataFrame:
    band = F.when(F.col("s") >= auto, "auto").when(F.col("s") >= review, "review").otherwise("none")
    return scored.withColumn("band", band)


def decided(scored: DataFrame, decisions: DataFrame, auto: float = 0.8) -> DataFrame:
    """scored with decision (merge, separate or '') of (a, b in any order) and whether the pair links its rows. Of several
    decisions on a pair the latest counts (column seq, if there is one), of equally late ones `separate`."""
    seq = F.col("seq") if "seq" in decisions.columns else F.lit(0)
    pair = decisions.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.struct(seq.alias("seq"), "decision").alias("d"))
    d = pair.groupBy("a", "b").agg(F.max("d")["decision"].alias("decision"))
    joined = bands(scored, auto).join(d, ["a", "b"], "left").withColumn("decision", F.coalesce("decision", F.lit("")))
    link = (F.col("decision") == "merge") | ((F.col("decision") != "separate") & (F.col("s") >= auto))
    return joined.withColumn("link", link)


def clusters(std: DataFrame, decided_pairs: DataFrame) -> DataFrame:
    """(row, cluster): the smallest row that links reach; rows without a link are their own cluster."""
    roots = components(decided_pairs.filter("link"), "a", "b")
    return std.select("row").join(roots.withColumnRenamed("node", "row"), "row", "left").select("row", F.coalesce("root", "row").alias("cluster"))


def review_queue(decided_pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """(a, b, s, linked, pending): pairs in the review band, best first; linked: joined through others already."""
    a = labels.select(F.col("row").alias("a"), F.col("cluster").alias("ca"))
    b = labels.select(F.col("row").alias("b"), F.col("cluster").alias("cb"))
    rows = decided_pairs.filter("band = 'review'").join(a, "a").join(b, "b")
    rows = rows.withColumn("linked", (F.col("decision") == "") & (F.col("ca") == F.col("cb")))
    return rows.select("a", "b", "s", "decision", "linked", ((F.col("decision") == "") & ~F.col("linked")).alias("pending")).orderBy(F.desc("s"), "a", "b")


def cluster_links(decided_pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """(cluster, links, weakest): clusters with links, the weakest link first."""
    rows = decided_pairs.filter("link").join(labels.withColumnRenamed("row", "a"), "a")
    return rows.groupBy("cluster").agg(F.count("*").alias("links"), F.min("s").alias("weakest")).orderBy("weakest", "cluster")


def completeness(std: DataFrame) -> DataFrame:
    filled = lambda c: F.when(F.trim(c) != "", 1).otherwise(0)
    golden = sum((filled(F.col(f)) for f in GOLDEN), F.lit(0))
    raws = sum((filled(F.col(c)) for c in std.columns if c.startswith("raw_")), F.lit(0)) + 1
    extra = F.size(F.filter(F.map_values("extra"), lambda v: F.trim(v) != ""))
    return std.withColumn("completeness", golden * 100 + raws + extra)


def golden(std: DataFrame, labels: DataFrame) -> DataFrame:
    """One row a cluster: master row, members, every field and prov, a map of field to {from, rule}.

    Master: the most complete row, then the latest. Volatile fields come from the latest row that has them, stable
    ones are the longest value, stage the highest, date the latest; pass-through columns the master's, else the first
    filled. Each is a grouped minimum over an ordering struct, so it is combined before the shuffle.
    """
    rows = completeness(std).join(labels, "row")
    late = F.struct((F.col("date") == "").alias("none"), F.translate("date", "0123456789-", "9876543210-").alias("back"))
    # Digits swapped for their complements order dates from the latest on.
    recent = F.struct(late.alias("l"), (-F.col("completeness")).alias("c"), F.col("row").alias("r"))
    full = F.struct((-F.col("completeness")).alias("c"), late.alias("l"), F.col("row").alias("r"))

    def pick(f: str, order: Column, when: Column | None = None) -> Column:
        body = F.struct(order.alias("o"), F.col(f).alias("v"), F.col("id").alias("from"))
        return F.min(body if when is None else F.when(when, body)).alias(f"p_{f}")

    aggs = [F.min(F.struct(full.alias("o"), F.col("row").alias("row"), F.col("id").alias("id"), F.col("extra").cast("string").alias("x"))).alias("m"), F.count("*").alias("members")]
    aggs += [pick(f, recent, F.trim(f) != "") for f in VOLATILE]
    aggs += [pick(f, F.struct((-F.length(f)).alias("n"), late.alias("l"), F.col("row").alias("r"))) for f in STABLE]
    aggs += [pick("stage", F.struct((-F.col("stage_rank")).alias("n"), F.col("row").alias("r"))), pick("date", recent)]
    g = rows.groupBy("cluster").agg(*aggs)
    rules = {**dict.fromkeys(VOLATILE, "most recent activity"), **dict.fromkeys(STABLE, "most complete value"), "stage": "highest lifecycle stage", "date": "latest date"}
    prov = F.map_from_entries(
        F.array_compact(
            F.array(*[F.when(F.coalesce(F.trim(f"p_{f}.v"), F.lit("")) != "", F.struct(F.lit(f).alias("k"), F.struct(F.col(f"p_{f}.from").alias("from"), F.lit(r).alias("rule")).alias("v"))) for f, r in rules.items()])
        )
    )
    return g.select("cluster", F.col("m.row").alias("master"), F.col("m.id").alias("id"), "members", *[F.coalesce(f"p_{f}.v", F.lit("")).alias(f) for f in GOLDEN], prov.alias("prov"))


def pass_through(std: DataFrame, labels: DataFrame, gold: DataFrame, column: str) -> DataFrame:
    """(cluster, value): the master's value of an unmapped column, else the first filled one."""
    rows = std.select("row", F.col("extra")[column].alias("v")).join(labels, "row").join(gold.select("cluster", "master"), "cluster")
    order = F.struct((F.col("row") != F.col("master")).alias("other"), "row")
    return rows.groupBy("cluster").agg(F.coalesce(F.min_by(F.when(F.trim("v") != "", F.col("v")), F.when(F.trim("v") != "", order)), F.lit("")).alias("value"))


def clean_table(gold: DataFrame, std: DataFrame, labels: DataFrame) -> DataFrame:
    """Golden records with merged_from, the other members' ids in order of their number."""
    others = std.select("row", "id").join(labels, "row")
    number = F.coalesce(F.regexp_extract("id", r"(\d+)$", 1).try_cast("long"), F.lit(0))
    ids = others.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct(number.alias("n"), "id"))).alias("ids"))
    merged = F.array_join(F.transform(F.filter("ids", lambda x: x["id"] != F.col("id")), lambda x: x["id"]), ";")
    return gold.join(ids, "cluster").withColumn("merged_from", merged).drop("ids", "prov")


def merge_log(gold: DataFrame, decided_pairs: DataFrame) -> DataFrame:
    """(kind, subject, detail): field provenance of merged records, links, and pairs kept separate."""
    fields = gold.filter("members > 1").select("cluster", F.explode("prov").alias("field", "p"))
    fields = fields.select(F.lit("field").alias("kind"), F.col("cluster").cast("string").alias("subject"), F.concat("field", F.lit(" from "), "p.from", F.lit(": "), "p.rule").alias("detail"))
    subject = F.concat_ws("|", "a", "b").alias("subject")
    links = decided_pairs.filter("link").select(F.lit("link").alias("kind"), subject, F.array_join("signals", ", ").alias("detail"))
    apart = decided_pairs.filter("decision = 'separate'").select(F.lit("kept separate").alias("kind"), subject, F.lit("").alias("detail"))
    return reduce(DataFrame.unionByName, [fields, links, apart])


def pair_metrics(labels: DataFrame, truth: DataFrame) -> DataFrame:
    """(precision, recall, f1) over pairs, from group sizes alone; truth: row, person."""
    rows = labels.join(truth, "row")
    pairs = lambda *by: rows.groupBy(*by).agg((F.count("*") * (F.count("*") - 1) / 2).alias("p")).agg(F.sum("p").alias("p"))
    both = pairs("cluster", "person").select(F.col("p").alias("hit")).join(pairs("cluster").select(F.col("p").alias("found"))).join(pairs("person").select(F.col("p").alias("real")))
    p = F.when(F.col("found") > 0, F.col("hit") / F.col("found")).otherwise(1.0)
    r = F.when(F.col("real") > 0, F.col("hit") / F.col("real")).otherwise(1.0)
    return both.select(p.alias("precision"), r.alias("recall")).withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))


def score_histogram(scored: DataFrame, bins: int = 25) -> DataFrame:
    return scored.groupBy(histogram_bin(F.col("s"), 0.0, 1.0, bins).alias("bin")).agg(F.count("*").alias("pairs"))


def stage_metrics(std: DataFrame, log: DataFrame, gold: DataFrame) -> DataFrame:
    """(rows, cells_changed, bad_phones, bad_emails, from_others): from_others counts golden values that a row other
    than the master gave."""
    other = F.size(F.filter(F.map_values("prov"), lambda p: p["from"] != F.col("id")))
    a = std.agg(F.count("*").alias("rows"), F.count_if(~F.col("phone_ok")).alias("bad_phones"), F.count_if(~F.col("email_valid")).alias("bad_emails"))
    return a.join(log.agg(F.count("*").alias("cells_changed"))).join(gold.agg(F.sum(other).alias("from_others")))
