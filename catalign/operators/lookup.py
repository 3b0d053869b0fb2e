"""Joins between catalogue tables.

Lookups first shrink the looked-up side to one row per key. A hot key on the
other side is then only a skewed probe, which adaptive execution splits; there
is never a product of two groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import paths as P


def unique_owner(catalog: DataFrame, keys: list[str], owner: str) -> DataFrame:
    """Per key the smallest owner and whether it is the only one.

    Smallest equal to largest says exactly one distinct owner, without
    collecting or counting distinct owners.
    """
    return catalog.groupBy(*keys).agg(
        F.min(owner).alias("owner"), (F.min(owner) == F.max(owner)).alias("only")
    )


def bind_by_unique_name(refs: DataFrame, catalog: DataFrame, name: str, asset: str) -> DataFrame:
    """Each reference with its asset when exactly one asset carries the name.

    ``status`` is resolved, ambiguous or missing. Catalogue rows are (asset,
    name) pairs after deduplication, every retained alias included.
    """
    index = unique_owner(catalog.filter(F.col(name) != ""), [name], asset)
    return (
        refs.join(index, name, "left")
        .withColumn("status", F.when(F.col("owner").isNull(), "missing").when(F.col("only"), "resolved")
                    .otherwise("ambiguous"))
        .withColumn("bound_asset", F.when(F.col("only"), F.col("owner")))
        .drop("owner", "only")
    )


def ambiguous_candidates(refs: DataFrame, catalog: DataFrame, name: str, asset: str) -> DataFrame:
    """Candidate assets of each ambiguous name, once per name and not per reference."""
    index = unique_owner(catalog, [name], asset).filter(~F.col("only")).select(name)
    wanted = index.join(refs.select(name).distinct(), name, "left_semi")
    return catalog.select(name, asset).distinct().join(wanted, name, "left_semi")


def hand_over_bindings(refs: DataFrame, catalog: DataFrame, held: DataFrame, name: str, asset: str, identity: str,
                       order: list[str]) -> DataFrame:
    """Bindings of each asset after references that resolve have handed theirs over: asset, identity, order columns, added.

    ``refs`` has one row per reference and binding (name, identity, order columns), ``held`` the bindings that assets have
    already (asset, identity, order columns). A binding an asset holds is kept as it is; of several references that bring the
    same binding the first in order does. Only names that exactly one asset carries resolve.
    """
    brought = bind_by_unique_name(refs.select(name, identity, *order), catalog, name, asset).filter(
        (F.col("status") == "resolved") & F.col(identity).isNotNull())
    both = held.select(asset, identity, *order, F.lit(False).alias("added")).unionByName(
        brought.select(F.col("bound_asset").alias(asset), identity, *order, F.lit(True).alias("added")))
    first = both.groupBy(asset, identity).agg(F.min_by(F.struct(*order, "added"), F.struct("added", *order)).alias("_first"))
    return first.select(asset, identity, "_first.*")


def count_handed_over(bindings: DataFrame, asset: str) -> DataFrame:
    """Per asset how many bindings it has and how many of them were handed over."""
    return bindings.groupBy(asset).agg(F.count("*").alias("bindings"), F.count_if("added").alias("added"))


def pair_files(files: DataFrame, index_ext: str, data_ext: str, path: str, order: list[str]) -> DataFrame:
    """Index files with the data file of the same stem, case-insensitive.

    An index without a partner keeps a null ``data_path``: it is no container.
    """
    keyed = files.select(
        path, *[c for c in order if c != path],
        P.path_key(P.replace_extension(path, "")).alias("pair_key"), P.extension(path).alias("_ext"),
    )

    def side(ext, name):
        return keyed.filter(F.col("_ext") == ext).groupBy("pair_key").agg(
            F.min_by(path, F.struct(*order)).alias(name))

    return side(index_ext, "index_path").join(side(data_ext, "data_path"), "pair_key", "left")


def lookup_two_keys(left: DataFrame, right: DataFrame, first: tuple[str, str], second: tuple[str, str],
                    value: str, order: list[str]) -> DataFrame:
    """Value by the first key; only misses use the second."""
    def side(key, name):
        return right.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias(f"_k_{name}")).agg(
            F.min_by(F.struct(value), F.struct(*order)).alias(name))

    a, b = side(first[1], "_a"), side(second[1], "_b")
    return (
        left.join(a, left[first[0]] == a["_k__a"], "left").join(b, left[second[0]] == b["_k__b"], "left")
        .withColumn(value, F.when(F.col("_a").isNotNull(), F.col("_a")[value]).otherwise(F.col("_b")[value]))
        .withColumn("matched_by", F.when(F.col("_a").isNotNull(), "first").when(F.col("_b").isNotNull(), "second"))
        .drop("_a", "_b", "_k__a", "_k__b")
    )


def ingest_external(files: DataFrame, manifest: DataFrame, path: str, hash_: str, value: str,
                    order: list[str]) -> DataFrame:
    """Attach the external manifest row by path, else by content hash."""
    return lookup_two_keys(files, manifest, (path, path), (hash_, hash_), value, order)


def lookup_profile(df: DataFrame, profiles: DataFrame, exact: str, code: str) -> DataFrame:
    """Profile by exact id, else the first whose family is part of the code.

    ``profiles`` has (profile, exact_id, family, priority). A code contains a
    family exactly if one of its substrings of the family's length equals it, so
    the distinct unmatched codes are expanded at the lengths that occur among
    families and joined on equality.
    """
    ids = profiles.filter(F.col("exact_id").isNotNull()).groupBy(F.col("exact_id").alias(exact)).agg(
        F.min_by("profile", "priority").alias("_by_id"))
    step = df.join(ids, exact, "left")
    family = profiles.filter(F.col("family").isNotNull()).groupBy(F.col("family").alias("_part")).agg(
        F.min_by(F.struct("profile", "priority"), "priority").alias("_row"))
    # Distinct lengths: a handful of numbers, bounded by the longest family.
    lengths = sorted(r[0] for r in family.select(F.length("_part")).distinct().collect())
    codes = step.filter(F.col("_by_id").isNull() & F.col(code).isNotNull()).select(code).distinct()
    sizes = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length(code))
    pieces = codes.select(code, F.explode(sizes).alias("_n")).select(code, F.explode(F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(code) - F.col("_n") + 1, F.lit(1))),
        lambda i: F.substring(F.col(code), i, F.col("_n"))))).alias("_part"))
    by_family = pieces.join(family, "_part").groupBy(code).agg(
        F.min_by("_row.profile", "_row.priority").alias("_by_family"))
    return (
        step.join(by_family, code, "left")
        .withColumn("profile", F.coalesce("_by_id", F.when(F.col("_by_id").isNull(), F.col("_by_family"))))
        .withColumn("profile_status", F.when(F.col("_by_id").isNotNull(), "exact")
                    .when(F.col("_by_family").isNotNull(), "family").otherwise("unsupported"))
        .drop("_by_id", "_by_family")
    )


def resolve_precedence(assets: DataFrame, aliases: DataFrame, asset: str, keys: list[Column]) -> DataFrame:
    """First alias found, in the order of ``keys``. One equi-join for all keys.

    ``aliases`` has (alias, target), one target per alias.
    """
    probes = assets.select(
        F.col(asset), F.posexplode(F.array(*[k.cast("string") for k in keys])).alias("priority", "alias")
    ).filter(F.col("alias").isNotNull())
    return probes.join(aliases, "alias").groupBy(asset).agg(
        F.min_by("target", "priority").alias("target"), F.min("priority").alias("priority"))


def resolve_mapping(mapping: DataFrame, files: DataFrame, hash_="hash", name="name", path="path") -> DataFrame:
    """Each hash with the one file its names resolve to.

    A name is a direct path, else the basename of exactly one file. All names
    of a hash must agree; ``n_files`` is 0, 1 or 2 for more than one.
    """
    direct = files.select(F.col(path).alias(name), F.col(path).alias("_direct")).distinct()
    by_leaf = unique_owner(files.select(P.leaf(path).alias("_leaf"), path), ["_leaf"], path).filter("only").select(
        "_leaf", F.col("owner").alias("_by_leaf"))
    hits = (
        mapping.join(direct, name, "left").withColumn("_leaf", P.leaf(name)).join(by_leaf, "_leaf", "left")
        .withColumn("_file", F.coalesce("_direct", "_by_leaf"))
    )
    return hits.groupBy(hash_).agg(F.min("_file").alias("_lo"), F.max("_file").alias("_hi")).select(
        hash_,
        F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).alias("file"),
        F.when(F.col("_lo").isNull(), 0).when(F.col("_lo") == F.col("_hi"), 1).otherwise(2).alias("n_files"),
    )


def rehydrate(assets: DataFrame, bindings: DataFrame, keys: list[str], value: str, fallback: tuple[str, Column, Column]
              | None = None, order: list[str] | None = None) -> DataFrame:
    """Fill a missing value by key, then by the fallback key when exactly one source has it.

    ``fallback`` = (name, key over assets, key over bindings).
    """
    order = order or [value]
    main = bindings.filter(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.min_by(value, F.struct(*order)).alias("_main"))
    out = assets.join(main, keys, "left")
    if fallback:
        name, left_key, right_key = fallback
        other = unique_owner(bindings.filter(F.col(value).isNotNull()).select(right_key.alias(name), value),
                             [name], value).filter("only").select(name, F.col("owner").alias("_fallback"))
        out = out.withColumn(name, left_key).join(other, name, "left").drop(name)
    else:
        out = out.withColumn("_fallback", F.lit(None).cast(out.schema["_main"].dataType))
    filled = F.coalesce(F.col(value), F.col("_main"), F.col("_fallback"))
    return out.withColumn("origin", F.when(F.col(value).isNotNull(), "kept").when(F.col("_main").isNotNull(), "key")
                          .when(F.col("_fallback").isNotNull(), "fallback").otherwise("missing")) \
        .withColumn(value, filled).drop("_main", "_fallback")


def bind_slots(slots: DataFrame, assets: DataFrame, key: str, asset: str, order: list[str]) -> DataFrame:
    """Binding key to its first owning asset; slots whose key nobody owns disappear."""
    owner = assets.groupBy(key).agg(F.min_by(asset, F.struct(*order)).alias(asset))
    return slots.join(owner, key)


def reconcile_refs(refs: DataFrame, catalog: DataFrame, payload: str, name: str, asset: str, limit: int) -> DataFrame:
    """Missing and ambiguous names per payload, rendered with counts taken before truncation."""
    from ..functions.names import render_names
    from .ranking import top_per_group

    pairs = refs.select(payload, name).distinct()
    bad = bind_by_unique_name(pairs, catalog, name, asset).filter(F.col("status") != "resolved").select(
        payload, "status", name)
    total = bad.groupBy(payload, "status").agg(F.count("*").alias("total"))
    shown = top_per_group(bad, [payload, "status"], [name], limit, "_n").groupBy(payload, "status").agg(
        F.array_sort(F.collect_list(name)).alias("shown"))
    detail = {
        "missing": "were not decoded anywhere in the scan",
        "ambiguous": "matched several assets and could not be bound",
    }
    message = F.when(F.col("status") == "missing", render_names("shown", "total", "name", detail["missing"])) \
        .otherwise(render_names("shown", "total", "name", detail["ambiguous"]))
    return total.join(shown, [payload, "status"]).select(payload, "status", "total", message.alias("message"))


def reconcile_counts(audit: DataFrame, production: DataFrame, keys: list[str], count: str) -> DataFrame:
    """Full comparison of two independent counts; excess on the audit side is an issue."""
    a = audit.select(*keys, F.col(count).alias("audit"))
    p = production.select(*keys, F.col(count).alias("production"))
    both = a.join(p, keys, "full").withColumns(
        {"audit": F.coalesce("audit", F.lit(0)), "production": F.coalesce("production", F.lit(0))})
    state = F.when(F.col("audit") > F.col("production"), "missed").when(
        F.col("audit") < F.col("production"), "extra").otherwise("equal")
    return both.withColumn("state", state)


def changed_rows(baseline: DataFrame, current: DataFrame, key: str, digest: str, size: str) -> DataFrame:
    """Rows edited since the baseline: size or digest differs, or is unreadable now."""
    b = baseline.select(key, F.col(digest).alias("_d"), F.col(size).alias("_s"))
    same = F.col(digest).eqNullSafe(F.col("_d")) & F.col(size).eqNullSafe(F.col("_s")) & F.col(digest).isNotNull()
    return current.select(key, digest, size).join(b, key).filter(~same).select(key)


def nesting_depth(files: DataFrame, roots: DataFrame, path="path", root="root", depth="depth") -> DataFrame:
    """Depth of the deepest registered root above a path, plus one."""
    prefixes = files.select(path, F.explode_outer(P.ancestors(path)).alias(root))
    known = roots.groupBy(root).agg(F.max(depth).alias("_d"))
    return prefixes.join(known, root, "left").groupBy(path).agg(
        (F.coalesce(F.max("_d"), F.lit(0)) + 1).alias("depth"))


def keep_live_name(assets: DataFrame, live: DataFrame, asset: str, hashes: str, name: str) -> DataFrame:
    """An existing file's name wins when all live hashes of an asset agree on one file.

    ``live`` has (hash, file), one file per hash.
    """
    probes = assets.select(asset, F.explode(hashes).alias("hash"))
    found = unique_owner(probes.join(live, "hash"), [asset], "file").filter("only").select(
        asset, F.col("owner").alias("_live"))
    return assets.join(found, asset, "left").withColumn(
        name, F.coalesce(P.leaf("_live"), F.col(name))).drop("_live")
