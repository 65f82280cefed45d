"""Links from a registry of firms: people behind them, families of firms, what else agrees between two firms, addresses by key ladder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnworks.functions import people
from cairnworks.operators import relational as ops

#: A cap for callers that hold a family of more firms for one that hangs on no one person's name.
MAX_FAMILY = 25
#: Classes of firms in a block of a family.
BLOCK = 500
STRONG = 3
#: Fields of a registry row that corroborate() compares, besides the lists.
FIELDS = ("state", "phone", "google_phone", "address", "postcode", "city", "domain", "ubi")


def verdict(points: Column, contradicted: Column) -> Column:
    return F.when(contradicted, "contradicted").when(points == 0, "name_only").when(points >= STRONG, "strong").otherwise("corroborated")


def _comparable(row: Column, key: Column) -> dict[str, Column]:
    """What corroborate() compares of a registry row and the key of its person, by name."""
    text = lambda c: F.nullif(F.upper(F.trim(row[c])), F.lit(""))
    digits = lambda c: F.when(F.length(F.regexp_replace(row[c], r"\D", "")) >= 7, F.regexp_replace(row[c], r"\D", ""))
    trades = F.array_distinct(F.transform(F.coalesce(row["trade_codes"], F.array().cast("array<string>")), F.lower))
    return {c: digits(c) if c in ("phone", "google_phone") else text(c) for c in FIELDS} | {"trades": F.array_sort(trades), "initial": people.key_initial(key)}


def _agreeing(a: Column | dict[str, Column], b: Column | dict[str, Column]) -> dict[str, Column]:
    """Whether two comparable rows agree, by field; null where that is not known."""
    google = a["google_phone"]
    return {
        "middle_initial": a["initial"] == b["initial"], "phone": a["phone"] == b["phone"], "google_phone": (google == b["google_phone"]) & ~google.eqNullSafe(a["phone"]),
        "address": a["address"] == b["address"], "postal_code": a["postcode"] == b["postcode"], "city": a["city"] == b["city"],
        "root_domain": a["domain"] == b["domain"], "ubi": a["ubi"] == b["ubi"], "trade": F.arrays_overlap(a["trades"], b["trades"]),
    }


def corroborate(a: Column, b: Column, key_a: Column, key_b: Column) -> Column:
    """struct(points, agreeing, against, verdict) of two registry rows (structs of FIELDS and trade_codes) and the keys of the person they share."""
    first, second = _comparable(a, key_a), _comparable(b, key_b)
    conflict = {"middle_initial": first["initial"] != second["initial"], "state": first["state"] != second["state"]}
    listed = lambda flags: F.array_compact(F.array(*(F.when(flag, name) for name, flag in flags.items())))
    made = F.struct(listed(_agreeing(first, second)).alias("agreeing"), listed(conflict).alias("against"))
    return F.element_at(F.transform(F.array(made), lambda s: F.struct(F.size(s["agreeing"]).alias("points"), s["agreeing"], s["against"], verdict(F.size(s["agreeing"]), F.array_contains(s["against"], "middle_initial")).alias("verdict"))), 1)


def _filed(registry: DataFrame) -> DataFrame:
    """(entity, name, key) of the persons behind the active firms of registry(entity, status, principals array of struct(name, key))."""
    active = registry.filter(F.col("status").isNull() | (F.col("status") == "active"))
    filed = active.select("entity", F.explode("principals").alias("p")).select("entity", F.col("p.name").alias("name"), people.full_principal_key(F.col("p.key")).alias("key"))
    return filed.filter("key is not null")


def families(registry: DataFrame, cap: int | None = None, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(members, dropped) of the groups of firms that share persons, directly or through others, by their full keys.

    registry(entity long, status, principals, FIELDS, trade_codes). members: (family, entity, size, min_points), family being its least key and
    min_points the fewest fields that agree between two of its firms. Groups of more than `cap` firms, if one is given, are left out
    whole and told as dropped: (family, size); without one every group is a family, whatever its size.
    """
    filed = ops.written(_filed(registry).select("entity", "key").distinct(), "families-filed")
    # Each firm of a person is joined to the first one of that person: the components are those of all pairs.
    least = filed.groupBy("key").agg(F.min("entity").alias("a"))
    edges = filed.join(least, "key").select("a", F.col("entity").alias("b")).filter("a <> b").distinct()
    groups = ops.written(ops.connected(edges), "families-groups")
    named = filed.join(groups, filed["entity"] == groups["node"]).groupBy("component").agg(F.min("key").alias("family"))
    sized = groups.groupBy("component").agg(F.count("*").alias("size")).join(named, "component")
    beyond = F.lit(False) if cap is None else F.col("size") > cap
    dropped = sized.filter(beyond).select("family", "size")
    held = groups.join(sized.filter(~beyond), "component").select("component", "family", "size", F.col("node").alias("entity"))
    keys = filed.groupBy("entity").agg(F.min("key").alias("key"))
    rows = held.join(registry.select("entity", F.struct(*FIELDS, "trade_codes").alias("row")), "entity").join(keys, "entity")
    rows = ops.written(rows, "families-rows")
    return rows.join(_weakest(rows, block), "component").select("family", "entity", "size", "min_points"), dropped


def _weakest(rows: DataFrame, block: int) -> DataFrame:
    """(component, min_points): the fewest fields that agree between two of rows(component, entity, row, key), of all pairs of a component.

    Rows of a component that compare alike are a class, and classes meet by pairs of blocks of `block` classes, dealt over all tasks. The first row of
    a pair is the one of the lesser entity, as it is read for one field more: two classes are compared the ways round that their entities allow.
    """
    read = rows.select("component", "entity", F.struct(*(v.alias(c) for c, v in _comparable(F.col("row"), F.col("key")).items())).alias("row"))
    classes = read.groupBy("component", "row").agg(F.min("entity").alias("least"), F.max("entity").alias("most"))
    blocks = ops.written(ops.blocks(classes.select("component", F.struct("least", "most", "row").alias("c")), ["component"], "c", "classes", block), "families-blocks")
    side = lambda x: blocks.select("component", F.col("block").alias(f"{x}_block"), F.col("classes").alias(x))
    met = ops.scattered(side("a").join(side("b"), "component"), "component", "a_block", "b_block")
    pairs = met.select("component", F.explode("a").alias("a"), "b").select("component", "a", F.explode("b").alias("b")).filter("a.least < b.most")
    points = sum((F.coalesce(flag.cast("int"), F.lit(0)) for flag in _agreeing(F.col("a.row"), F.col("b.row")).values()), F.lit(0))
    return pairs.groupBy("component").agg(F.min(points).alias("min_points"))


def family_rollup(members: DataFrame, bound: DataFrame, on_projects: DataFrame) -> DataFrame:
    """(family, entities, bound_entities, orgs, projects): bound(org, entity), on_projects(org, project). A project that several firms of a
    family work on counts once; organisations that are bound to no firm do not count."""
    orgs = members.select("family", "entity").join(bound, "entity", "left")
    counts = orgs.groupBy("family").agg(F.count_distinct("entity").alias("entities"), F.count_distinct(F.when(F.col("org").isNotNull(), F.col("entity"))).alias("bound_entities"), F.count_distinct("org").alias("orgs"))
    worked = orgs.join(on_projects, "org").select("family", "project").distinct().groupBy("family").agg(F.count("*").alias("projects"))
    return counts.join(worked, "family", "left").withColumn("projects", F.coalesce("projects", F.lit(0)))


def person_index(registry: DataFrame) -> DataFrame:
    """(core, entity, principal_name, principal_key, namesakes): the firms of each person by 'SURNAME|GIVEN', once a firm (its least key), and how
    many different full keys stand behind that name."""
    filed = _filed(registry).withColumn("core", people.core_of_principal(F.col("key"))).filter("core is not null")
    each = filed.groupBy("core", "entity").agg(F.min(F.struct("key", "name")).alias("p")).select("core", "entity", F.col("p.name").alias("principal_name"), F.col("p.key").alias("principal_key"))
    known = filed.select("core", "key").distinct().groupBy("core").agg(F.count("*").alias("namesakes"))
    return each.join(known, "core")


def matched_people(candidates: DataFrame, registry: DataFrame) -> DataFrame:
    """A row for each candidate and firm whose person bears the candidate's name, with the signals for and against.

    candidates(candidate, person_name, bound_entity, jurisdictions, role); registry(entity, name, city, status, principals). The name is read in both
    orders and must have a surname that the registry knows. Signals are nullable booleans: middle_initial, unique_name, surname_echo, city, role.
    """
    surname = F.substring_index("core", "|", 1)
    none = F.array().cast("array<string>")
    # What a signal asks of either side is read once a row; rows of a name that answer alike are a class, and signals are of two classes.
    index = person_index(registry).join(registry.select("entity", F.col("name").alias("entity_name"), F.upper("city").alias("city")), "entity")
    index = index.select("core", "entity", "namesakes", people.key_initial(F.col("principal_key")).alias("filed"), F.when(F.upper("entity_name").contains(surname), F.lit(True)).alias("surname_echo"), "city")
    index = ops.written(ops.blocks(index, ["core", "namesakes", "filed", "surname_echo", "city"], "entity", "entities"), "people-index").drop("block")
    read = candidates.withColumns({"core": people.person_core_key(F.col("person_name")), "own": people.person_parts(F.col("person_name"))["middle"]}).filter("core is not null")
    read = read.select(
        "core", F.struct("candidate", "bound_entity").alias("c"), "own", F.transform(F.coalesce("jurisdictions", none), lambda j: F.upper(j)).alias("places"), F.when(F.col("role") == "primary_contractor", F.lit(True)).alias("role")
    )
    read = ops.written(ops.blocks(read, ["core", "own", "places", "role"], "c", "candidates"), "people-read").drop("block")
    met = read.join(index, "core")
    signals = {
        "middle_initial": F.col("own") == F.col("filed"), "unique_name": F.when(F.col("namesakes") == 1, F.lit(True)).when(F.col("namesakes") >= 3, F.lit(False)), "surname_echo": F.col("surname_echo"),
        "city": F.when((F.col("city") != "") & F.exists("places", lambda j: j.contains(F.col("city"))), F.lit(True)), "role": F.col("role"),
    }
    rows = met.select("core", "namesakes", "candidates", "entities", *(s.alias(n) for n, s in signals.items()))
    points = sum((F.coalesce(F.col(n).cast("int"), F.lit(0)) for n in signals), F.lit(0))
    rows = rows.withColumn("points", points).withColumn("verdict", verdict(F.col("points"), F.coalesce(~F.col("middle_initial"), F.lit(False))))
    told = ["core", "namesakes", *signals, "points", "verdict"]
    rows = ops.scattered(rows, F.xxhash64("candidates", "entities"))
    rows = rows.select(*told, "candidates", F.explode("entities").alias("entity")).select(*told, "entity", F.explode("candidates").alias("c"))
    return rows.select("c.candidate", "core", "entity", "namesakes", F.col("c.bound_entity").eqNullSafe(F.col("entity")).alias("already_bound"), *signals, "points", "verdict")


def bound_by_address(wanted: DataFrame, owners: DataFrame) -> DataFrame:
    """(key, owner, rank, address_key): the best rung of each address's ladder that exactly one owner holds.

    wanted(key, address, zip), owners(owner, address, zip); an owner is found under every rung of its own. A rung that several owners hold says nothing, and the next one is tried.
    """
    ladder = lambda df, column: df.select(column, F.posexplode(people.key_ladder(F.col("address"), F.col("zip"))).alias("rank", "address_key"))
    unique = ops.unique_owners(ladder(owners, "owner"), "address_key", "owner")
    met = ladder(wanted, "key").join(unique, "address_key")
    return met.groupBy("key").agg(F.min(F.struct("rank", "address_key", "owner")).alias("b")).select("key", "b.owner", "b.rank", "b.address_key")
