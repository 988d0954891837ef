"""Analysis of a record graph: records with typed links, and what is missing between them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.detectors import DATA_OPEN, UNREPORTED, data_access, distinctive, is_common, name_score, readiness, says
from ..functions.scalars import normal_text
from ..storage import materialise
from .ranking import numbered


def edges(records: DataFrame, key: str = "id", links: str = "links") -> DataFrame:
    """``src, relation, dst`` from an array of structs ``relation, target_id``."""
    return records.select(F.col(key).alias("src"), F.explode(links).alias("l")).select("src", F.col("l.relation").alias("relation"), F.col("l.target_id").alias("dst"))


def linked(e: DataFrame, relation: str) -> DataFrame:
    return e.filter(F.col("relation") == relation).select("src", "dst")


def members(e: DataFrame, relation: str) -> DataFrame:
    """``dst, n, sources``: an inverted index; where a node may have very many, ``membership.bitmaps`` has them without lists."""
    return linked(e, relation).groupBy("dst").agg(F.count_distinct("src").alias("n"), F.array_sort(F.collect_set("src")).alias("sources"))


def tier(areas: Column, first: Sequence[str], second: Sequence[str]) -> Column:
    """1 if any area is of the first kind, else 2 for the second, else 3."""
    return F.when(F.arrays_overlap(areas, F.array(*[F.lit(a) for a in first])), 1).when(F.arrays_overlap(areas, F.array(*[F.lit(a) for a in second])), 2).otherwise(3)


def without_evidence(subjects: DataFrame, evidence: DataFrame, key: str) -> DataFrame:
    """Subjects that no evidence row names."""
    return subjects.join(evidence.select(key).distinct(), key, "left_anti")


def seen_in_several(rows: DataFrame, item: str, study: str, at_least: int = 2) -> DataFrame:
    """``item, studies`` of items of ``at_least`` distinct studies."""
    return rows.groupBy(item).agg(F.count_distinct(study).alias("studies")).filter(F.col("studies") >= at_least)


def study_flags(rows: DataFrame, subject: str, study: str, origin: str, own: str) -> DataFrame:
    """Per subject: ``studies, single_study, no_independent`` (all rows of the own origin)."""
    return rows.groupBy(subject).agg(F.count_distinct(study).alias("studies"), (F.count_distinct(study) == 1).alias("single_study"), F.bool_and(F.col(origin) == own).alias("no_independent"))


def most_frequent(rows: DataFrame, subject: str, value: str) -> DataFrame:
    """``subject, value, n``: the most frequent value, the smallest of equals."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(subject, value).agg(F.count("*").alias("n"))
    return counts.withColumn("_r", F.row_number().over(Window.partitionBy(subject).orderBy(F.desc("n"), value))).filter("_r = 1").drop("_r")


def best_reason(rows: DataFrame, subject: str, rules: Sequence[tuple[str, Column]], otherwise: str) -> DataFrame:
    """``subject, reason``: of the rules that any row of a subject meets, the first in order."""
    hit = F.coalesce(*[F.when(c, F.lit(i)) for i, (_, c) in enumerate(rules)], F.lit(len(rules)))
    names = F.array(*[F.lit(n) for n, _ in rules], F.lit(otherwise))
    return rows.groupBy(subject).agg(F.min(hit).alias("_i")).select(subject, F.element_at(names, F.col("_i") + 1).alias("reason"))


def screened(rows: DataFrame, rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """``rows`` with ``reasons``, all rules that exclude a row, and ``kept``, whether there are none."""
    reasons = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules]))
    return rows.withColumn("reasons", reasons).withColumn("kept", F.size("reasons") == 0)


def first_per_pair(rows: DataFrame, keys: Sequence[str], ordinal: str) -> DataFrame:
    """The first row of each key in source order."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(ordinal))).filter("_r = 1").drop("_r")


def proposals(rows: DataFrame, bucket: str, value: str, per_hour: str, flags: str, key: str) -> DataFrame:
    """``rows`` with ``place`` from 1: by bucket, then value per hour in bucket 1, value, number of flags, and key."""
    order = [F.asc(bucket), F.when(F.col(bucket) == 1, -F.coalesce(F.col(per_hour), F.lit(0.0))).asc_nulls_first(), F.desc(value), F.desc(flags), F.asc(key)]
    return numbered(rows, order)


def filed(placed: DataFrame, benchmark: str, cap: int = 5) -> DataFrame:
    """The first ``cap`` proposals with at most one of each benchmark; those without a benchmark are not held back."""
    first = F.row_number().over(Window.partitionBy(benchmark).orderBy("place"))
    return placed.withColumn("_r", first).filter((F.col("_r") == 1) | F.col(benchmark).isNull()).drop("_r").orderBy("place").limit(cap)


def newest_release(tags: DataFrame, prefixes: Sequence[str], name: str = "name", created: str = "created") -> DataFrame:
    """One row of ``release, created``: the latest release that has a tag of every prefix (``prefix/release``)."""
    parts = tags.select(F.substring_index(name, "/", 1).alias("prefix"), F.substring_index(name, "/", -1).alias("release"), created).filter(F.col("prefix").isin(*prefixes))
    whole = parts.groupBy("release").agg(F.count_distinct("prefix").alias("n"), F.max(created).alias("created")).filter(F.col("n") == len(prefixes))
    return whole.orderBy(F.desc("created"), F.desc("release")).limit(1).select("release", "created")


def rankings(mappings: DataFrame, evaluations: DataFrame, at_least: int = 2) -> DataFrame:
    """``use_case, systems`` of active direct mappings of the first tier whose evaluations cover ``at_least`` distinct systems.

    ``mappings`` has ``use_case, tier, status, directness, evaluation_ids``;
    ``evaluations`` has ``id, system``.
    """
    chosen = mappings.filter("tier = 1 AND status = 'active' AND directness = 'direct'").select("use_case", F.explode("evaluation_ids").alias("id")).distinct()
    return chosen.join(evaluations.select("id", "system"), "id").groupBy("use_case").agg(F.count_distinct("system").alias("systems")).filter(F.col("systems") >= at_least)


def never_executed(recipes: DataFrame, parts: DataFrame, runs: DataFrame) -> DataFrame:
    """Recipes (``id``) that have no run, neither of themselves nor of anything they lead to along ``parts`` (``src, dst``)."""
    from .graph import closure

    reach = closure(parts, recipes.select(F.col("id").alias("root"))).select(F.col("root").alias("id"), "node").unionByName(recipes.select("id", F.col("id").alias("node")))
    ran = reach.join(runs.select(F.col("id").alias("node")).distinct(), "node", "left_semi").select("id").distinct()
    return recipes.join(ran, "id", "left_anti")


def estimates(gaps: DataFrame, runtimes: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """``gap, pairs, known, gpu_hours, lower_bound``: hours of all (system, protocol) pairs of a gap.

    ``gaps`` has ``gap, systems, protocols`` (arrays), ``runtimes`` has
    ``system, protocol, hours, gpus`` of which the first of a pair counts.  Where
    a pair has no runtime the sum is a lower bound.
    """
    first = first_per_pair(runtimes.filter("hours IS NOT NULL"), ["system", "protocol"], ordinal).select("system", "protocol", (F.col("hours") * F.coalesce("gpus", F.lit(1))).alias("h"))
    systems, protocols = F.array_distinct("systems"), F.array_distinct("protocols")
    sized = gaps.select("gap", systems.alias("systems"), protocols.alias("protocols"), (F.size(systems) * F.size(protocols)).alias("pairs"))
    # only pairs that have a runtime are looked for: by system, then by protocol
    found = sized.select("gap", F.explode("systems").alias("system"), "protocols").join(first, "system").filter(F.array_contains(F.col("protocols"), F.col("protocol")))
    sums = found.groupBy("gap").agg(F.count("*").alias("known"), F.sum("h").alias("gpu_hours"))
    out = sized.select("gap", "pairs").join(sums, "gap", "left").withColumn("known", F.coalesce("known", F.lit(0)))
    return out.select("gap", "pairs", "known", "gpu_hours", (F.col("known") < F.col("pairs")).alias("lower_bound"))


def linked_datasets(e: DataFrame, gaps: DataFrame, relations: Sequence[str], same: str = "same_data_as") -> DataFrame:
    """``gap, dataset``: what a gap's members link to by any of the relations, and one hop of equal data further, in both directions.

    ``gaps`` has ``gap, member``.
    """
    direct = gaps.join(e.filter(F.col("relation").isin(*relations)), F.col("member") == F.col("src")).select("gap", F.col("dst").alias("dataset")).distinct()
    equal = linked(e, same).unionByName(linked(e, same).select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    hop = direct.join(equal, F.col("dataset") == F.col("src")).select("gap", F.col("dst").alias("dataset"))
    return direct.unionByName(hop).distinct()


def unfiled(proposals: DataFrame, issues: DataFrame, key: str = "key", aliases: str = "aliases", body: str = "body") -> DataFrame:
    """Proposals whose key and aliases stand in no hidden marker ``<!-- key: ... -->`` of an issue."""
    filed = issues.select(F.explode(F.regexp_extract_all(body, F.lit(r"<!--\s*key:\s*(\S+)\s*-->"), F.lit(1))).alias("name")).distinct()
    names = proposals.select(key, F.explode(F.concat(F.array(F.col(key)), F.coalesce(F.col(aliases), F.array().cast("array<string>")))).alias("name"))
    return proposals.join(names.join(filed, "name", "left_semi").select(key).distinct(), key, "left_anti")


def best_cover(proposals: DataFrame, issues: DataFrame, least: int = 1) -> DataFrame:
    """``key, issue, score`` of the issue that names each proposal best (``name_score``), the smallest of equals; scores under ``least`` are none.

    ``proposals`` has ``key, name``; ``issues`` has ``issue, title``, whose title
    may be all of an issue's text.  An issue that holds a name in full holds its
    rarest word; one that holds two of its k specific words holds one of their
    k - 1 rarest.  So a proposal is looked up by these few words only, rarest in
    the issues, and words that most texts share pair nothing.
    """
    p = proposals.select("key", "name").filter("key IS NOT NULL AND name IS NOT NULL").distinct()
    i = issues.select("issue", normal_text(F.col("title")).alias("text")).filter("issue IS NOT NULL AND text IS NOT NULL").distinct()
    words = F.array_distinct(F.filter(F.split(normal_text(F.col("name")), " "), lambda w: w != ""))
    specific = F.array_distinct(F.transform(F.filter(distinctive(F.col("name")), lambda w: ~is_common(w)), lambda w: F.lower(w)))
    # ``whole``: all of these words must be there; else ``needed`` of them
    asked = p.select("key", "name", F.explode(F.array(F.struct(F.lit(True).alias("whole"), words.alias("words")), F.struct(F.lit(False).alias("whole"), specific.alias("words")))).alias("a")).select("key", "name", "a.*")
    asked = asked.withColumn("needed", F.when(F.col("whole"), F.size("words")).otherwise(F.least(F.lit(2), F.size("words")))).select("key", "name", "whole", "needed", F.explode("words").alias("word"))
    texts = materialise(i.select("issue", F.explode(F.array_distinct(F.split("text", " "))).alias("word")).join(asked.select("word").distinct(), "word", "left_semi"))
    found = asked.join(texts.groupBy("word").agg(F.count("*").alias("issues")), "word")
    of_name = Window.partitionBy("key", "name", "whole")
    placed = found.withColumns({"_n": F.count("*").over(of_name), "_r": F.row_number().over(of_name.orderBy("issues", "word"))})
    keys = placed.filter(F.col("_r") <= F.col("_n") - F.col("needed") + 1).select("key", "name", "word")
    pairs = keys.join(texts, "word").select("key", "name", "issue").distinct()
    scored = pairs.join(i, "issue").select("key", "issue", name_score(F.col("text"), F.col("name")).alias("score")).filter(F.col("score") >= least)
    best = scored.groupBy("key").agg(F.min_by(F.struct("issue", "score"), F.struct(-F.col("score"), "issue")).alias("b"))
    return best.select("key", "b.issue", "b.score")


def slim(records: DataFrame, keys: Sequence[str], attributes: str = "attributes", key: str = "id") -> DataFrame:
    """``key`` and a column of each wanted attribute of a map; values that say nothing was reported are null."""
    value = {k: F.trim(F.try_element_at(attributes, F.lit(k))) for k in keys}
    return records.select(key, *[F.when((v != "") & ~v.rlike(UNREPORTED), v).alias(k) for k, v in value.items()])


def ready_recipes(candidates: DataFrame, protocols: DataFrame, owner: str = "owner") -> DataFrame:
    """``owner, recipe, state``: of each owner's candidates, guides before recipes and evaluations first, the first that leads to a score, and whether it can be followed.

    ``candidates`` has ``owner, recipe, kind`` (guide or recipe), ``purpose,
    protocol, ordinal, outputs`` (an array) and ``run_text``; ``protocols`` has the
    known ``protocol`` ids.  A guide, and a recipe of the owner's own id, needs no
    known protocol.  Owners whose candidates all fail keep the first one's state.
    """
    known = candidates.join(protocols.select("protocol", F.lit(True).alias("_known")).distinct(), "protocol", "left")
    free = (F.col("kind") == "guide") | F.col("protocol").isNull() | (F.col("protocol") == F.col(owner)) | F.coalesce("_known", F.lit(False))
    judged = known.withColumn("state", readiness(F.col("outputs"), F.col("run_text"), free))
    place = F.struct(F.col("state").isin("no score", "unknown protocol").alias("_fails"), (F.col("kind") != "guide").alias("_a"), (F.coalesce("purpose", F.lit("")) != "generate_and_evaluate").alias("_b"), "ordinal")
    best = judged.groupBy(owner).agg(F.min_by(F.struct("recipe", "state"), place).alias("b"))
    return best.select(owner, "b.recipe", "b.state")


#: Kinds of records by how specific they are; others lie between the last two.
SPECIFIC = {"task": 0, "protocol": 1, "benchmark": 3}


def discrepancy_anchors(compared: DataFrame, ancestors: DataFrame, kinds: DataFrame, finding: str = "finding") -> DataFrame:
    """``finding, rule, anchor, protocols``: what a rerun would have to run to settle a finding.

    ``compared`` has ``finding, study, role, ordinal, protocol``; ``ancestors``
    has ``protocol, anchor`` (a protocol itself among them); ``kinds`` has
    ``anchor, kind``.  Protocols that two studies share come first (``shared``;
    the anchor is the smallest), then the most specific record that protocols
    of two studies are part of (``part``), else the protocols of the first
    study with the role outlier or party, or of the first study (``own``).
    """
    rows = compared.filter("protocol IS NOT NULL").select(finding, "study", "role", "ordinal", "protocol").distinct()
    shared = rows.groupBy(finding, "protocol").agg(F.count_distinct("study").alias("n")).filter("n >= 2").groupBy(finding).agg(F.min("protocol").alias("anchor"), F.array_sort(F.collect_set("protocol")).alias("protocols"))
    under = rows.join(ancestors, "protocol")
    specific = F.coalesce(*[F.when(F.col("kind") == k, F.lit(v)) for k, v in SPECIFIC.items()], F.lit(2))
    common = under.groupBy(finding, "anchor").agg(F.count_distinct("study").alias("n")).filter("n >= 2").join(kinds, "anchor", "left")
    best = common.groupBy(finding).agg(F.min_by("anchor", F.struct(specific, -F.col("n"), "anchor")).alias("anchor"))
    part = under.join(best, [finding, "anchor"]).groupBy(finding, "anchor").agg(F.array_sort(F.collect_set("protocol")).alias("protocols"))
    chosen = rows.groupBy(finding).agg(F.min_by("study", F.struct(~F.coalesce(F.col("role").isin("outlier", "party"), F.lit(False)), "ordinal", "study")).alias("study"))
    own = rows.join(chosen, [finding, "study"]).groupBy(finding).agg(F.min("protocol").alias("anchor"), F.array_sort(F.collect_set("protocol")).alias("protocols"))
    ranked = [d.select(finding, F.lit(i).alias("_i"), F.lit(name).alias("rule"), "anchor", "protocols") for i, (name, d) in enumerate((("shared", shared), ("part", part), ("own", own)))]
    every = ranked[0].unionByName(ranked[1]).unionByName(ranked[2])
    return every.groupBy(finding).agg(F.min_by(F.struct("rule", "anchor", "protocols"), "_i").alias("b")).select(finding, "b.rule", "b.anchor", "b.protocols")


def missing_evidence(subjects: DataFrame, evidence: DataFrame, proxies: DataFrame, key: str) -> DataFrame:
    """Subjects that no evidence row names, with ``proxies``, the distinct studies of their proxy rows (``key, study``)."""
    counts = proxies.groupBy(key).agg(F.count_distinct("study").alias("proxies"))
    return without_evidence(subjects, evidence, key).join(counts, key, "left").withColumn("proxies", F.coalesce("proxies", F.lit(0)))


def verification_gaps(evidence: DataFrame, rankings: DataFrame, benchmarks: DataFrame, own: str, independent: Sequence[str]) -> DataFrame:
    """``system, benchmark, use_cases, flags, studies, protocols, rankings``: systems whose rank rests on one study, or on no independent result.

    ``evidence`` has ``use_case, system, study, origin``, ``rankings`` ``use_case,
    protocol, system`` and ``benchmarks`` ``protocol, benchmark`` (a protocol
    without one stands for itself).  A use case flags a ranked system
    ``single-study`` if all its evidence is of one study and not all of the
    origin ``own``, and ``no-independent`` if none has an independent origin.
    The gap is about the benchmark that has most of the system's rankings in the
    use case, the smallest of equals; several use cases may share a gap.
    """
    stats = evidence.groupBy("use_case", "system").agg(F.count_distinct("study").alias("_studies"), F.coalesce(F.bool_and(F.col("origin") == own), F.lit(False)).alias("_own"), F.coalesce(F.bool_or(F.col("origin").isin(*independent)), F.lit(False)).alias("_free"))
    single = F.when((F.col("_studies") == 1) & ~F.col("_own"), "single-study")
    flagged = stats.withColumn("_flags", F.array_compact(F.array(single, F.when(~F.col("_free"), "no-independent")))).filter(F.size("_flags") > 0).select("use_case", "system", "_flags")
    ranked = rankings.select("use_case", "protocol", "system").distinct().join(benchmarks.select("protocol", "benchmark").distinct(), "protocol", "left").withColumn("benchmark", F.coalesce("benchmark", "protocol"))
    held = ranked.join(flagged, ["use_case", "system"]).groupBy("use_case", "system", "benchmark").agg(F.count("*").alias("_n"), F.first("_flags").alias("_flags"))  # one value per group
    chosen = held.groupBy("use_case", "system").agg(F.min_by(F.struct("benchmark", "_flags"), F.struct(-F.col("_n"), "benchmark")).alias("c")).select("use_case", "system", "c.benchmark", "c._flags")
    gap = ["system", "benchmark"]
    facts = chosen.groupBy(*gap).agg(F.array_sort(F.collect_set("use_case")).alias("use_cases"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("_flags"))), lambda a, b: F.when(a == b, 0).when(a == "single-study", -1).otherwise(1)).alias("flags"))
    studies = chosen.join(evidence, ["use_case", "system"]).groupBy(*gap).agg(F.count_distinct("study").alias("studies"))
    protocols = chosen.join(ranked, ["use_case", *gap]).select(*gap, "protocol").distinct()
    counts = protocols.join(ranked.select("use_case", "system", "protocol"), ["system", "protocol"]).groupBy(*gap).agg(F.array_sort(F.collect_set("protocol")).alias("protocols"), F.count("*").alias("rankings"))
    return facts.join(studies, gap).join(counts, gap)


def obtainable_data(gaps: DataFrame, statements: DataFrame, recipes: DataFrame, same: DataFrame) -> DataFrame:
    """``gap, state, record``: whether the data of a run can be had, and the record that decides.

    ``gaps`` has ``gap, record, is_data``, the records of a run (its datasets and
    what it is about); ``statements`` has ``record, access, notes``; ``recipes``
    has ``gap, ready`` (boolean); ``same`` has ``src, dst``, records of equal
    data.  A closed statement wins (``closed``; the smallest record), then a
    recipe that is ready (``recipe``), then ``open`` if every dataset, or one of
    equal data, says where it is.  Else it is ``unknown``: the record is the
    first dataset without a source, or null without datasets.
    """
    said = statements.groupBy("record").agg(F.bool_or(data_access(F.col("access"), F.col("notes")) == "closed").alias("_closed"), F.bool_or(says(F.col("access"), DATA_OPEN)).alias("_open"))
    rows = gaps.groupBy("gap", "record").agg(F.bool_or("is_data").alias("is_data")).join(said, "record", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("_closed", "_open")})
    both = same.select("src", "dst").unionByName(same.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    twins = both.join(said.filter("_open"), F.col("dst") == F.col("record"), "left_semi").select(F.col("src").alias("record"), F.lit(True).alias("_twin")).distinct()
    rows = rows.join(twins, "record", "left").withColumn("_found", F.col("_open") | F.coalesce("_twin", F.lit(False)))
    per = rows.groupBy("gap").agg(F.min(F.when(F.col("_closed"), F.col("record"))).alias("_shut"), F.min(F.when(F.col("is_data"), F.col("record"))).alias("_data"), F.min(F.when(F.col("is_data") & ~F.col("_found"), F.col("record"))).alias("_lost"))
    ready = recipes.groupBy("gap").agg(F.bool_or("ready").alias("_ready"))
    out = per.join(ready, "gap", "left")
    has_recipe = F.coalesce("_ready", F.lit(False))
    state = F.when(F.col("_shut").isNotNull(), "closed").when(has_recipe, "recipe").when(F.col("_data").isNotNull() & F.col("_lost").isNull(), "open").otherwise("unknown")
    return out.select("gap", state.alias("state"), F.when(F.col("_shut").isNotNull(), F.col("_shut")).when(has_recipe, None).otherwise(F.coalesce("_lost", "_data")).alias("record"))


def top_proxies(proxies: DataFrame, key: str, record: str, study: str, n: int = 3) -> DataFrame:
    """``key, record, studies, place``: of each subject the ``n`` proxies with the most distinct studies, the smaller record of equals."""
    counts = proxies.groupBy(key, record).agg(F.count_distinct(study).alias("studies"))
    w = Window.partitionBy(key).orderBy(F.desc("studies"), record)
    return counts.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


#: What says that a record follows another (a fixed value).
SUCCEEDS = r"(?i)\b(?:successor (?:to|of)|supersedes) (?:the )?([^.;\n]+)"


def successors(systems: DataFrame, described: DataFrame, most_words: int = 8) -> DataFrame:
    """``id, successor, how``: the later system that the records name for each system.

    ``systems`` has ``id, name, superseded_by``; ``described`` has ``id, text``.
    A recorded ``superseded_by`` comes first (``attribute``), then a record of
    another id that ``supersedes`` the name or is its "successor to" or "of" it
    (``text``; the smallest id).  A name has three characters at least and
    ``most_words`` words at most, and stands there as whole words.
    """
    named = systems.select("id", normal_text(F.col("name")).alias("name")).filter(F.length("name") >= 3)
    phrases = described.select(F.col("id").alias("by"), F.explode(F.regexp_extract_all("text", F.lit(SUCCEEDS), F.lit(1))).alias("phrase"))
    words = F.split(normal_text(F.col("phrase")), " ")
    starts = phrases.select("by", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.size(words), F.lit(most_words))), lambda k: F.array_join(F.slice(words, F.lit(1), k), " "))).alias("name")).distinct()
    by_text = starts.join(named, "name").filter("by <> id").groupBy("id").agg(F.min("by").alias("_text"))
    out = systems.groupBy("id").agg(F.min("superseded_by").alias("_attribute")).join(by_text, "id", "left").filter("_attribute IS NOT NULL OR _text IS NOT NULL")
    return out.select("id", F.coalesce("_attribute", "_text").alias("successor"), F.when(F.col("_attribute").isNotNull(), "attribute").otherwise("text").alias("how"))


def use_case_facts(use_cases: DataFrame, described: DataFrame, clinical: Sequence[str], first: Sequence[str], second: Sequence[str]) -> DataFrame:
    """``id, title, slug, question, contexts, clinical, tier`` of every use case, completed from the record of its id.

    ``use_cases`` has ``id, title, slug, question, contexts, area``, all but the
    id nullable; ``described`` has ``id, name, description, contexts, areas,
    tier``, one row per id.  The record's contexts, areas and tier come first,
    the use case's own title, slug and question.
    """
    r = described.select("id", F.col("name").alias("_name"), F.col("description").alias("_text"), F.col("contexts").alias("_contexts"), F.col("areas").alias("_areas"), F.col("tier").alias("_tier"))
    none = F.array().cast("array<string>")
    contexts = F.when(F.size("_contexts") > 0, F.col("_contexts")).otherwise(F.coalesce("contexts", none))
    areas = F.when(F.size("_areas") > 0, F.col("_areas")).otherwise(F.array_compact(F.array("area")))
    found = F.coalesce(F.arrays_overlap(contexts, F.array(*[F.lit(c) for c in clinical])), F.lit(False))
    return use_cases.join(r, "id", "left").select(
        "id", F.coalesce("title", "_name", "id").alias("title"), F.coalesce("slug", F.regexp_replace("id", "^use-case-", "")).alias("slug"), F.coalesce("question", "_text", F.lit("")).alias("question"),
        contexts.alias("contexts"), found.alias("clinical"), F.coalesce("_tier", tier(areas, first, second)).alias("tier"),
    )


def valued(gaps: DataFrame, members: DataFrame, facts: DataFrame) -> DataFrame:
    """``gaps`` with ``value, bucket, per_gpu_hour``, what ``proposals`` ranks by.

    ``gaps`` has ``gap, rankings, estimate`` (cpu, gpu or another word) and
    ``gpu_hours``; ``members`` has ``gap, use_case``; ``facts`` has ``id,
    clinical``.  The value is one more than the rankings, twice that if any use
    case is clinical.
    """
    weight = members.join(facts.select(F.col("id").alias("use_case"), "clinical"), "use_case").groupBy("gap").agg(F.bool_or("clinical").alias("_clinical"))
    value = F.when(F.coalesce("_clinical", F.lit(False)), 2).otherwise(1) * (1 + F.col("rankings"))
    bucket = F.when(F.col("estimate") == "cpu", 0).when(F.col("estimate") == "gpu", 1).otherwise(2)
    out = gaps.join(weight, "gap", "left").withColumns({"value": value, "bucket": bucket}).drop("_clinical")
    return out.withColumn("per_gpu_hour", F.when((F.col("estimate") == "gpu") & (F.col("gpu_hours") > 0), F.col("value") / F.col("gpu_hours")))
