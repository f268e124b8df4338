"""Messages from files, strings and mailboxes: raw bytes in, one row per message out."""

from __future__ import annotations

import email
import email.policy
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAIL = (
    "source string, text string, html string, subject string, from_address string, reply_to string, message_id string, date string, to array<string>, "
    "header_lines array<struct<key:string,line:string>>, attachments array<struct<filename:string,content_type:string,content:binary>>"
)


def parse_message(source: str | None, raw: bytes | str | None) -> dict:
    """A message by the standard library; what can't be parsed is a message of text only."""
    data = raw.encode("utf-8", "surrogateescape") if isinstance(raw, str) else bytes(raw or b"")
    empty = {"source": source, "text": None, "html": None, "subject": None, "from_address": None, "reply_to": None, "message_id": None, "date": None, "to": [], "header_lines": [], "attachments": []}
    try:
        m = email.message_from_bytes(data, policy=email.policy.default)
        out = empty | {
            "subject": m["subject"], "from_address": m["from"], "reply_to": m["reply-to"], "message_id": m["message-id"], "date": m["date"],
            "to": [str(a) for a in m.get_all("to", [])], "header_lines": [{"key": k.lower(), "line": f"{k}: {v}"} for k, v in m.items()],
        }
        out = {k: str(v) if v is not None and k in ("subject", "from_address", "reply_to", "message_id", "date") else v for k, v in out.items()}
        files = []
        for p in m.walk():
            if p.is_multipart():
                continue
            if p.get_filename() or p.get_content_disposition() == "attachment":
                files.append({"filename": p.get_filename(), "content_type": p.get_content_type(), "content": p.get_payload(decode=True) or b""})
            elif p.get_content_type() in ("text/plain", "text/html"):
                k = "text" if p.get_content_type() == "text/plain" else "html"
                out[k] = (out[k] or "") + str(p.get_content())
        return out | {"attachments": files}
    except Exception:  # noqa: BLE001 - any broken message
        return empty | {"text": data.decode("utf-8", "replace")}


def parse_mail(df: DataFrame, source: str, raw: str) -> DataFrame:
    """df(source, raw) -> one MAIL row each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([parse_message(s, r) for s, r in zip(b["source"], b["raw"])], columns=[c.split()[0] for c in re.split(r", (?=\w+ (?:string|array))", MAIL)])

    return df.select(F.col(source).alias("source"), F.col(raw).alias("raw")).mapInPandas(run, MAIL)


def read_eml(spark: SparkSession, path: str, pattern: str = "*.eml") -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return parse_mail(files, "path", "content")


def read_corpus(spark: SparkSession, path: str, ignore: str | None = None) -> DataFrame:
    """Every file below a folder as (path, label, content); label is the folder's name. ignore: pattern of paths to leave out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    kept = files.where(~F.col("path").rlike(ignore)) if ignore else files
    return kept.select("path", F.element_at(F.split("path", "/"), -2).alias("label"), "content")


def read_training_json(spark: SparkSession, path: str) -> DataFrame:
    """Training rows from a JSON array or from JSON lines."""
    schema = "id long, subject string, message string, label int, label_text string, text string, date string"
    first = spark.read.text(path).limit(1).first()
    return spark.read.schema(schema).option("multiLine", bool(first and first[0].lstrip().startswith("["))).json(path)
