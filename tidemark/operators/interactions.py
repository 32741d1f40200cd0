"""Conjunctions of signature features: atoms, candidate sets, support counts and the rules mined from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import beta_shrunk
from tidemark.operators.ordered import running

MOST_ATOMS, MOST_SETS = 28, 6000
SILENT = ("", "-", "NO_SIGNAL", "NO SIGNAL", "NONE", "NULL", "NAN")  # fixed values

# The prefixes of each namespace's parts.
PARTS = {
    "trig": ("rel", "cx", "tr", "dir", "sg", "dw"),
    "proj": ("a", "c", "h", "dw"),
    "ent": ("p", "r", "d", "dw", "v"),
    "mom": ("r", "m", "s", "c", "dw"),
    "cg": ("f", "s", "q", "dw"),
    "ns": ("v", "p", "d", "a", "dw"),
    "sf": ("m", "n1", "n2", "d", "dw"),
    "lab": ("len", "sum", "dw", "v"),
    "trail": ("nt", "pev", "t", "dw"),
}
# Priority of a feature when atoms are chosen; 10 for any other.
PRIORITY = {
    "model": 100, "state": 95, "dw": 90, "a": 90, "b": 90, "c": 90,
    "sum": 85, "repeated": 80, "rel": 90, "dir": 88, "pair": 88,
    "form": 88, "dircode": 85, "m": 88, "v": 80, "p": 85,
    "flow": 85, "f": 80, "q": 80, "h": 75, "r": 75, "s": 75,
    "t": 70, "cx": 65, "tr": 65, "sg": 65, "n1": 70, "n2": 70,
    "namespace": 20, "result": 20,
}


def _feature(name: str | Column, value: Column) -> Column:
    return F.struct((F.lit(name) if isinstance(name, str) else name).alias("feature"), value.alias("value"))


def signature_features(signature: Column) -> Column:
    """Array of (feature, value) that a signature's text holds, for any namespace; values may be null."""
    tagged = signature.contains(":")
    space = F.when(tagged, F.split_part(signature, F.lit(":"), F.lit(1))).otherwise("unknown")
    body = F.when(tagged, F.get(F.split(signature, ":", 2), F.lit(1)))
    parts = F.split(body, "_")
    none = F.lit(None).cast("struct<feature:string,value:string>")

    def after(k: int) -> Column:
        return F.slice(parts, k + 1, F.greatest(F.size(parts) - k, F.lit(0)))

    def named(part: Column, names: tuple[str, ...]) -> Column:
        # the longest prefix that leaves something names the part
        found = none
        for prefix in sorted(names, key=len):
            found = F.when(part.startswith(prefix) & (F.length(part) > len(prefix)), _feature(prefix, F.substring(part, len(prefix) + 1, 1000))).otherwise(found)
        return found

    def prefixed(parts: Column, *names: str) -> Column:
        return F.transform(parts, lambda part: named(part, names))

    def token(among: tuple[str, ...]) -> Column:
        return F.element_at(F.filter(parts, lambda x: x.isin(*among)), -1)

    def last_token(among: tuple[str, ...]) -> Column:
        return F.when(F.size(F.filter(parts, lambda x: x.isin(*among))) > 0, token(among))

    a, b, c, dw = (F.regexp_extract(body, r"^(\d+)-(\d+)-(\d+)(?:_dw(\d+))?$", i) for i in (1, 2, 3, 4))
    repeated = F.when((a == b) | (b == c) | (a == c), "true").otherwise("false")
    residues = F.array(
        _feature("a", a), _feature("b", b), _feature("c", c), _feature("sum", (a.try_cast("int") + b.try_cast("int") + c.try_cast("int")).cast("string")), _feature("repeated", repeated), _feature("dw", F.when(dw != "", dw))
    )
    second = F.get(parts, F.lit(1))
    code = F.when(second.isin("mid", "bull", "bear", "hi", "lo"), second).when(F.array_contains(parts, "mid"), "mid")
    streak = F.regexp_extract(body, r"(?:^|_)st([A-Za-z0-9]+)$", 1)
    candle = [
        _feature("form", F.when(F.array_contains(parts, "body"), "body").otherwise(F.get(parts, F.lit(0)))), _feature("dircode", code),
        _feature("st", F.when(streak != "", streak)), _feature("candle_dir", last_token(("D", "U"))),
    ]
    found = F.when((space == "crt") & (a != ""), residues)
    found = found.when(space == "traj", F.concat(F.array(*(_feature(n, F.get(parts, F.lit(i))) for i, n in enumerate(("shape", "model", "state")))), prefixed(after(3), "dw")))
    flow = F.when(second.startswith("p"), F.substring(second, 2, 1000))
    found = found.when(space == "nsflow", F.array(_feature("flow", F.get(parts, F.lit(0))), _feature("p", flow)))
    found = found.when(space == "cs", F.concat(F.transform(parts, lambda x, i: _feature(F.concat(F.lit("part"), i.cast("string")), x)), F.array(*candle)))
    # the staking signature's result is all of its first part, length included
    found = found.when(space == "lab", F.concat(F.array(_feature("result", F.get(parts, F.lit(0)))), prefixed(after(1), *PARTS["lab"])))
    found = found.when(space == "trail", F.concat(prefixed(parts, *PARTS["trail"]), F.array(_feature("pair", last_token(("UD", "DU", "DD", "UU"))))))
    for name in PARTS:
        if name not in ("lab", "trail"):
            found = found.when(space == name, prefixed(parts, *PARTS[name]))
    found = F.filter(F.coalesce(found, F.array().cast("array<struct<feature:string,value:string>>")), lambda x: x.isNotNull() & x.value.isNotNull())
    return F.concat(F.array(_feature("namespace", space)), found)


def has_signature(signature: Column) -> Column:
    """A signature that says something."""
    return F.coalesce(~F.trim(signature).isin(*SILENT), F.lit(False))


def state_summary(outputs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, state_json (canonical JSON of [engine, direction, signature], sorted), n_signatures and n_directional of every moment's outputs."""
    said = F.when(F.col("direction").isin("UP", "DOWN"), F.col("direction")).otherwise("NO_SIGNAL")
    rows = outputs.where(has_signature(F.col("signature"))).select(*keys, "engine", said.alias("direction"), "signature")
    triples = F.array_sort(F.collect_list(F.array("engine", "direction", "signature")))  # an engine each
    directional = F.count_distinct(F.when(F.col("direction") != "NO_SIGNAL", F.col("engine")))
    return rows.groupBy(*keys).agg(F.to_json(triples).alias("state_json"), F.count_distinct("engine").alias("n_signatures"), directional.alias("n_directional"))


def atoms(outputs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, kind, engine, feature and atom (``key=value``) of every engine's output (keys, engine, direction, signature)."""
    rows = outputs.where(has_signature(F.col("signature"))).withColumn("_s", F.col("signature"))
    exact = rows.select(*keys, F.lit("exact_signature").alias("kind"), "engine", F.lit("signature").alias("feature"), F.concat(F.lit("sig."), "engine", F.lit("="), "_s").alias("atom"))
    way = rows.where(F.col("direction").isin("UP", "DOWN")).select(*keys, F.lit("direction").alias("kind"), "engine", F.lit("direction").alias("feature"), F.concat(F.lit("dir."), "engine", F.lit("="), "direction").alias("atom"))
    parts = rows.select(*keys, "engine", F.explode(signature_features(F.col("_s"))).alias("x"))
    parts = parts.select(*keys, F.lit("structural").alias("kind"), "engine", "x.feature", F.concat(F.lit("feat."), "engine", F.lit("."), "x.feature", F.lit("="), "x.value").alias("atom"))
    return exact.unionByName(way).unionByName(parts).distinct()


def selected_atoms(found: DataFrame, keys: Sequence[str], most: int = MOST_ATOMS) -> DataFrame:
    """keys and atoms: signatures first, then directions, then features by priority; ``most`` of them, sorted."""
    rank = F.when(F.col("kind") == "exact_signature", 0).when(F.col("kind") == "direction", 1).otherwise(2)
    known = F.create_map(*(F.lit(x) for pair in PRIORITY.items() for x in pair))
    first = F.when(rank == 2, -F.coalesce(known[F.col("feature")], F.lit(10))).otherwise(0)
    order = F.sort_array(F.collect_list(F.struct(rank.alias("rank"), first.alias("first"), "engine", "atom")))  # some dozen atoms a key
    return found.groupBy(*keys).agg(order.alias("o")).select(*keys, F.array_sort(F.transform(F.slice("o", 1, most), lambda x: x.atom)).alias("atoms"))


def interaction_key(atoms: Column) -> Column:
    """Canonical JSON of a set of atoms."""
    return F.to_json(F.array_sort(F.array_distinct(atoms)))


def interaction_hash(atoms: Column) -> Column:
    return F.sha2(interaction_key(atoms), 256)


def pairs(atoms: Column) -> Column:
    """All sets of two of a sorted array, in order."""
    n = F.size(atoms)
    i = F.when(n >= 2, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.flatten(F.transform(i, lambda a: F.transform(F.sequence(a + 1, n), lambda b: F.array(F.element_at(atoms, a), F.element_at(atoms, b)))))


def extended(sets: Column, atoms: Column) -> Column:
    """Each set with one more atom that sorts after its last one, in order."""
    return F.flatten(F.transform(sets, lambda s: F.transform(F.filter(atoms, lambda x: x > F.element_at(s, -1)), lambda x: F.concat(s, F.array(x)))))


def bounded_sets(atoms: Column, most_atoms: int = MOST_ATOMS, most: int = MOST_SETS) -> Column:
    """Sets of two, then three, then four of the first atoms in order, ``most`` at most."""
    kept = F.slice(F.array_sort(F.array_distinct(atoms)), 1, most_atoms)
    two = pairs(kept)
    three = extended(two, kept)
    left = F.greatest(F.lit(0), most - F.size(two) - F.size(three))
    # quadruples are many: only as many triples are extended as can still count
    four = F.slice(extended(F.slice(three, 1, F.least(F.size(three), F.lit(most))), kept), 1, left)
    return F.slice(F.concat(two, three, four), 1, most)


def set_support(observations: DataFrame, sets: Column) -> DataFrame:
    """key, n, up, down of every set over the observations (next_outcome UP or DOWN)."""
    rows = observations.where(F.col("next_outcome").isin("UP", "DOWN")).select(F.explode(sets).alias("s"), "next_outcome")
    return rows.groupBy(F.to_json("s").alias("key")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("next_outcome") == "UP").alias("up"), F.count_if(F.col("next_outcome") == "DOWN").alias("down"))


def ranked(support: DataFrame, least: int = 5) -> DataFrame:
    """Supported sets with p (shrunk share of ups), effect and score = effect * sqrt(n)."""
    p = beta_shrunk(F.col("up"), F.col("n"))
    rows = support.where(F.col("n") >= least).withColumn("p", p).withColumn("effect", F.abs(F.col("p") - 0.5))
    return rows.withColumn("score", F.col("effect") * F.sqrt("n"))


def mined_rules(observations: DataFrame, keys: Sequence[str], least: int = 5, most_pairs: int = 5000, most_dense: int = 14, most_a_row: int = 5000) -> DataFrame:
    """Rules (key, size, n, up, down, p, effect, score) by staged mining over observations (keys, atoms, next_outcome).

    All pairs are counted; of the supported ones the ``most_pairs`` best are kept. Triples and quadruples are
    built only from a row's first ``most_dense`` atoms and only where every pair in them is kept.
    """
    rows = observations.withColumn("atoms", F.slice(F.array_sort(F.array_distinct("atoms")), 1, MOST_ATOMS))
    two = ranked(set_support(rows, pairs(F.col("atoms"))), least).orderBy(F.desc("score"), F.desc("n"), "key").limit(most_pairs)
    dense = rows.select(*keys, "next_outcome", F.slice("atoms", 1, most_dense).alias("dense"))
    held = dense.select(*keys, F.explode(pairs(F.col("dense"))).alias("pair")).withColumn("key", F.to_json("pair"))
    held = held.join(F.broadcast(two.select("key")), "key").groupBy(*keys).agg(F.collect_list("pair").alias("kept"))  # ``most_pairs`` keys at most
    rows = dense.join(held, list(keys))

    def supported(s: Column) -> Column:
        return F.forall(pairs(s), lambda p: F.array_contains("kept", p))

    triples = F.filter(extended(F.array_sort("kept"), F.col("dense")), supported)
    quads = F.filter(extended(triples, F.col("dense")), supported)
    out = two.withColumn("size", F.lit(2))
    for size, sets in ((3, triples), (4, quads)):
        out = out.unionByName(ranked(set_support(rows, F.slice(sets, 1, most_a_row)), least).withColumn("size", F.lit(size)))
    return out


def sway(observations: DataFrame, keys: Sequence[str], sets: Column | None = None, least: int = 5, least_effect: float = 0.04, most: int = 24) -> DataFrame:
    """keys, n_matched, p_up and direction of each observation (keys, us, label_us, atoms, next_outcome) from the sets that it matches.

    A set's statistics are those of the observations whose outcome was known (label_us) by the observation's own
    time us: labels and lookups of a set stand in one order by time, labels first, and sums run along it.
    """
    sets = bounded_sets(F.col("atoms")) if sets is None else sets
    rows = observations.select(*keys, "us", "label_us", "next_outcome", F.explode(sets).alias("s")).withColumn("key", F.to_json("s")).drop("s")
    up = F.when(F.col("next_outcome") == "UP", 1).otherwise(0)
    moment = F.struct(*keys)
    known = rows.where(F.col("next_outcome").isin("UP", "DOWN") & F.col("label_us").isNotNull()).select("key", F.col("label_us").alias("_us"), F.lit(0).alias("_kind"), moment.alias("_moment"), up.alias("_up"))
    asked = rows.select("key", F.col("us").alias("_us"), F.lit(1).alias("_kind"), moment.alias("_moment"), F.lit(None).cast("int").alias("_up"))
    sums = {"n": F.when(F.col("_up").isNull(), 0).otherwise(1), "up": F.coalesce("_up", F.lit(0))}
    rows = running(known.unionByName(asked), ["key"], ["_us", "_kind", "_moment"], sums).where("_kind = 1")
    rows = ranked(rows, least).where(F.col("effect") >= least_effect)
    rank = F.row_number().over(Window.partitionBy("_moment").orderBy(F.desc("score"), F.desc("n"), "key"))
    best = rows.withColumn("_rank", rank).where(F.col("_rank") <= most)
    g = best.groupBy("_moment").agg(F.count(F.lit(1)).alias("n_matched"), (F.sum(F.col("p") * F.sqrt("n")) / F.sum(F.sqrt("n"))).alias("p_up"))
    direction = F.when(F.col("p_up") > 0.55, "UP").when(1 - F.col("p_up") > 0.55, "DOWN").otherwise("NO_SIGNAL")
    return g.select("_moment.*", "n_matched", "p_up", direction.alias("direction"))


def swayed(direction: Column, sway_direction: Column) -> Column:
    """What the sway does to an engine's direction: reversal, continuation, or none where either says nothing."""
    both = direction.isin("UP", "DOWN") & sway_direction.isin("UP", "DOWN")
    return F.when(both & (direction != sway_direction), "reversal").when(both, "continuation").otherwise("none")


def agreement(seed_direction: Column, adaptive_direction: Column) -> Column:
    """A: both votes say the same way, C: they conflict, N: at least one says nothing."""
    both = seed_direction.isin("UP", "DOWN") & adaptive_direction.isin("UP", "DOWN")
    return F.when(both & (seed_direction == adaptive_direction), "A").when(both, "C").otherwise("N")


def fused(seed_up: Column, seed_down: Column, adaptive_up: Column) -> tuple[Column, Column]:
    """Probability of a rise from a seed vote and the adaptive one (0.45 and 0.55 of those present), and its direction."""
    seed = F.coalesce(seed_up, 1 - seed_down)
    p = F.when(seed.isNotNull() & adaptive_up.isNotNull(), 0.45 * seed + 0.55 * adaptive_up).otherwise(F.coalesce(seed, adaptive_up))
    return p, F.when(p >= 0.55, "UP").when(p <= 0.45, "DOWN").otherwise("NO_SIGNAL")
