"""Reading and writing tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Envelope fields at the JSON edge; anything absent is null.
ENVELOPE = """
    protocol string, goal string, step int, maxSteps int, image string, pageTitle string,
    viewport struct<w:int,h:int,dpr:double,scrollY:double>,
    semanticTokens array<struct<token:string,label:string,severity:int,source:string,box:struct<x:int,y:int,w:int,h:int>>>,
    actionMap array<struct<ref:string,role:string,type:string,label:string,sensitive:boolean,box:struct<x:int,y:int,w:int,h:int>>>,
    history array<struct<step:int,action:struct<op:string,ref:string,text:string>,ok:boolean,code:string>>,
    attestation struct<sanitized:boolean,allRegionsUniform:boolean,sanitizedSha256:string,rawSha256:string,rawBytes:bigint,sanitizedBytes:bigint,maskCount:int>
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def envelopes(df: DataFrame, column: str) -> DataFrame:
    """JSON texts as ``envelope`` structs; a text that doesn't parse gives nulls."""
    return df.withColumn("envelope", F.from_json(column, ENVELOPE, {"mode": "PERMISSIVE"}))


def envelope(protocol: str, goal: Column, step: Column, max_steps: Column, image: Column, viewport: Column, title: Column, regions: Column, actions: Column, history: Column, attestation: Column) -> Column:
    """The struct of an outgoing envelope. ``regions`` travel as tokens, without
    any value; of the history the last six entries."""
    token = lambda r: F.struct(r["token"].alias("token"), r["label"].alias("label"), r["severity"].alias("severity"), r["source"].alias("source"), r["box"].alias("box"))
    return F.struct(
        F.lit(protocol).alias("protocol"), goal.alias("goal"), step.alias("step"), max_steps.alias("maxSteps"), image.alias("image"), viewport.alias("viewport"), F.coalesce(title, F.lit("")).alias("pageTitle"),
        F.transform(regions, token).alias("semanticTokens"), actions.alias("actionMap"), F.slice(history, F.greatest(F.size(history) - 5, F.lit(1)), 6).alias("history"), attestation.alias("attestation"),
    )


def metadata(envelope: Column) -> Column:
    """An envelope's JSON without its image, nulls included: what a firewall scans."""
    return F.to_json(envelope.dropFields("image"), {"ignoreNullFields": "false"})


def images(spark: SparkSession, path: str) -> DataFrame:
    """Image files as path, length and content."""
    return spark.read.format("binaryFile").load(path).select("path", "length", "content")


def append_audit(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)
