"""The twelve string features of a mail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailloom.functions import mime

#: The features in their order.
FEATURES = ["subject", "text_payloads", "html_payloads", "image_payloads", "payload_types", "html_skeletons", "uri_amount", "schemes_string", "hosts_string", "total_attachment_size", "attachment_fil_extensions", "attachment_names"]
CATEGORICAL = ["payload_types", "uri_amount", "schemes_string", "hosts_string", "total_attachment_size", "attachment_fil_extensions"]
NON_CATEGORICAL = ["text_payloads", "html_payloads", "image_payloads", "subject", "html_skeletons", "attachment_names"]

#: Fixed value: what counts as a link. Groups: scheme, user, host, path, query, fragment. The host takes as much of
#: the path as leaves one character of it.
_C = r"[a-zA-Z0-9\-_\.~/\[\]]+"
URI = rf"(https|http|ftp|mailto|file|data|irc):(?://({_C}@)?({_C}(?::[0-9]+)?)?)?({_C})(\?{_C})?(\#{_C})?"
STEP, STEPS = 64 * 1024, 256


def uri_amount(text: Column) -> Column:
    """Number of links, repeated ones too, as text."""
    return F.regexp_count(text, F.lit(URI)).cast("string")


def schemes(text: Column) -> Column:
    """Distinct schemes of the links, sorted, without separator."""
    return F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(URI), F.lit(1)))), "")


def hosts(text: Column) -> Column:
    """Distinct hosts of the links, sorted, without separator; a link without host gives ``None``."""
    found = F.transform(F.regexp_extract_all(text, F.lit(URI), F.lit(3)), lambda h: F.when(h == "", "None").otherwise(h))
    return F.array_join(F.array_sort(F.array_distinct(found)), "")


def hosts_clean(text: Column) -> Column:
    """Distinct true hosts of http, https and ftp links, sorted."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"(?:https?|ftp)://(?:[^\s/@]*@)?([A-Za-z0-9.-]+)"), F.lit(1)), F.lower)))


def size_bucket(n_bytes: Column) -> Column:
    """The least multiple of 64 KiB above the size, 16 MiB at most, as text."""
    return (F.least(F.floor(n_bytes / F.lit(STEP)) + 1, F.lit(STEPS)) * STEP).cast("bigint").cast("string")


def extension(name: Column) -> Column:
    """The last dot of a file name and what follows; empty for names without, or with dots at the front only."""
    return F.regexp_extract(name, r"^(?:.*/)?\.*[^./][^/]*(\.[^./]*)$", 1)


def extracted(mails: DataFrame) -> DataFrame:
    """features(mail_id and the twelve) of every mail without error; a duplicate mail_id counts once.

    Missing values are empty strings. html_skeletons is the observed variant that takes text strings
    out of the whole page.
    """
    first = mails.filter(F.col("error").isNull()).groupBy("mail_id").agg(F.max_by(F.struct("raw", "headers", "payloads"), "raw").alias("m")).select("mail_id", "m.*")
    kind = {"PLAINTEXT": "text", "HTMLTEXT": "html", "IMAGE": "image"}
    texts = F.transform("payloads", lambda p: F.struct(p.content_type.alias("kind"), p.content.alias("content"), p.encoding.alias("encoding"), p.charset.alias("charset")))
    d = first.select("mail_id", "headers", "payloads", mime.part_texts(texts).alias("texts"), mime.attachments("raw").alias("files"))

    def joined(name: str, field: Column) -> Column:
        both = F.zip_with("payloads", field, lambda p, t: F.when(p.content_type == name, t))
        return F.array_join(F.filter(both, lambda x: x.isNotNull()), "")

    content = F.transform("payloads", lambda p: p.content)
    names = F.filter(F.transform("files", lambda a: a["name"]), lambda x: x.isNotNull())
    types = F.transform("payloads", lambda p: F.coalesce(*[F.when(p.content_type == k, v) for k, v in kind.items()], F.lit("")))
    d = d.select("mail_id", F.coalesce(F.col("headers")["Subject"], F.lit("")).alias("subject"), joined("PLAINTEXT", F.col("texts")).alias("text_payloads"), joined("HTMLTEXT", F.col("texts")).alias("html_payloads"), joined("IMAGE", content).alias("image_payloads"), F.array_join(types, "").alias("payload_types"), "texts", "payloads", "files", names.alias("names"))
    is_text = lambda p: p.content_type.isin("PLAINTEXT", "HTMLTEXT")
    visible = F.array_join(F.filter(F.zip_with("payloads", "texts", lambda p, t: F.when(is_text(p), t)), lambda x: x.isNotNull()), "\n")
    pages = F.filter(F.zip_with("payloads", "texts", lambda p, t: F.when(p.content_type == "HTMLTEXT", t)), lambda x: x.isNotNull())
    total = F.aggregate("files", F.lit(0).cast("bigint"), lambda s, a: s + a["n_bytes"])
    d = d.withColumn("visible", visible).withColumn("total", total)
    return d.select(
        "mail_id", "subject", "text_payloads", "html_payloads", "image_payloads", "payload_types", mime.skeletons(pages).alias("html_skeletons"),
        uri_amount(F.col("visible")).alias("uri_amount"), schemes(F.col("visible")).alias("schemes_string"), hosts(F.col("visible")).alias("hosts_string"),
        size_bucket(F.col("total")).alias("total_attachment_size"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("names", extension))), "").alias("attachment_fil_extensions"),
        F.array_join(F.array_sort("names"), "").alias("attachment_names"),
    )


def selected(features: DataFrame, *, categorical: bool = True, non_categorical: bool = True, without: tuple[str, ...] = ()) -> DataFrame:
    """The toggled subset of the features; an unknown name raises KeyError."""
    for x in without:
        if x not in FEATURES:
            raise KeyError(x)
    keep = [f for f in FEATURES if (categorical and f in CATEGORICAL or non_categorical and f in NON_CATEGORICAL) and f not in without]
    return features.select("mail_id", *keep)
