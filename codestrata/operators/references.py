"""Resolving references of infrastructure files and Terraform: one target or none."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codestrata.functions.ids import ancestors, directory_of, normal_join
from codestrata.operators.link import link_references as terraform_references
from codestrata.operators.resolve import by_unique_suffix, subset_matches


def link_references(facts: DataFrame, files: DataFrame) -> DataFrame:
    """(repo, from, to, ref_kind, confidence): every reference fact with exactly one target; the rest is dropped.

    needs and stages resolve in the same file; `./` actions to the action's file, others to `ext:action/…` without
    their version; config tokens to a path or unique suffix; config-refs to the one resource of that kind and
    name; selectors to the one resource whose pod labels contain them; helm values to the nearest values file
    above (med); images stay external.
    """
    refs = facts.where("fact = 'ref' and kind <> 'hcl-ref'").select("repo", "file", "caller", "callee", F.col("kind").alias("ref_kind"))
    decls = facts.where("fact = 'decl'").select("repo", "file", "name", "kind", "specifier")
    high, med = F.lit("high").alias("confidence"), F.lit("med").alias("confidence")
    out = ["repo", "file", "caller", "ref_kind"]
    parts = []

    names = decls.select("repo", "file", "name").distinct()
    stage = refs.where("ref_kind in ('from-image', 'copy-from') and callee like 'stage.%'").withColumnRenamed("callee", "name")
    parts.append(stage.join(names, ["repo", "file", "name"]).select(*out, F.concat("file", F.lit("#"), "name").alias("to"), high))
    parts.append(refs.where("callee like 'ext:image/%'").select(*out, F.col("callee").alias("to"), high))

    jobs = decls.where("kind in ('job', 'task')").select("repo", "file", "name", F.regexp_replace("name", r"^\w+\.", "").alias("callee"))
    parts.append(refs.where("ref_kind = 'needs'").join(jobs, ["repo", "file", "callee"]).select(*out, F.concat("file", F.lit("#"), "name").alias("to"), high))

    uses = refs.where("ref_kind = 'uses'")
    known = files.select("repo", "path").distinct()
    local = uses.where("callee like './%'").withColumn("__base", normal_join(F.lit("."), F.col("callee")))
    tried = local.select("*", F.explode(F.array(F.col("__base"), F.concat("__base", F.lit("/action.yml")), F.concat("__base", F.lit("/action.yaml")))).alias("path"))
    parts.append(tried.join(known, ["repo", "path"]).select(*out, F.col("path").alias("to"), high))
    parts.append(uses.where("callee not like './%'").select(*out, F.concat(F.lit("ext:action/"), F.substring_index("callee", "@", 1)).alias("to"), high))

    config = refs.where("ref_kind = 'config'").withColumn("token", F.regexp_replace(F.regexp_replace("callee", "^\\./", ""), "/$", ""))
    parts.append(config.join(by_unique_suffix(config.select("repo", "token"), known), ["repo", "token"]).select(*out, F.col("path").alias("to"), high))

    resources = decls.where("kind = 'resource' and name like 'resource.%.%'").withColumn("callee", F.concat(F.element_at(F.split("name", r"\."), 2), F.lit("/"), F.regexp_replace("name", r"^resource\.[^.]+\.", "")))
    one = resources.withColumn("__n", F.count("*").over(Window.partitionBy("repo", "callee"))).where("__n = 1").select("repo", "callee", F.concat("file", F.lit("#"), "name").alias("to"))
    parts.append(refs.where("ref_kind = 'config-ref'").join(one, ["repo", "callee"]).select(*out, "to", high))

    # selectors carry their repository in the labels, so that a match stays inside it
    labels = lambda text: F.map_concat(F.str_to_map(text, F.lit(","), F.lit("=")), F.create_map(F.lit("__repo"), F.col("repo")))
    wanted = refs.where("ref_kind = 'selector' and callee <> ''").withColumn("selector", F.concat_ws("\n", "repo", "file", "caller"))
    there = decls.where("kind = 'resource' and specifier <> ''").select(F.concat("file", F.lit("#"), "name").alias("item"), labels(F.col("specifier")).alias("labels"))
    matched = subset_matches(wanted.select("selector", labels(F.col("callee")).alias("labels")), there)
    parts.append(wanted.join(matched, "selector").select(*out, F.col("item").alias("to"), high))

    values = decls.where(F.col("file").rlike(r"(^|/)values\.ya?ml$")).select("repo", "file", directory_of(F.col("file")).alias("dir"), "name")
    keys = refs.where("ref_kind = 'helm-values'").withColumn("name", F.concat(F.lit("variable."), F.substring_index("callee", ".", 1)))
    above = keys.select("*", F.posexplode(ancestors(F.col("file"))).alias("__far", "dir"))
    hits = above.join(values.withColumnRenamed("file", "__values"), ["repo", "dir", "name"])
    near = hits.groupBy(*out, "callee").agg(F.min(F.struct("__far", F.concat("__values", F.lit("#"), "name").alias("to"))).alias("__t"))
    parts.append(near.select(*out, F.col("__t.to").alias("to"), med))

    source = F.when(F.col("caller").isNull(), F.col("file")).otherwise(F.concat("file", F.lit("#"), "caller"))
    every = reduce(DataFrame.unionByName, parts).select("repo", source.alias("from"), "to", "ref_kind", "confidence")
    every = every.unionByName(terraform_references(facts).withColumn("confidence", high))
    return every.where("`from` <> `to`").groupBy("repo", "from", "to", "ref_kind").agg(F.min("confidence").alias("confidence"))
