"""Pseudonyms for recipients, listed domains and phone numbers, stable over mails without any state.

A pseudonym is a hash of the salt and the key in lower case, so the same original gets the same
replacement in every mail and on every executor. Keys are applied longest first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailloom.functions import mime
from mailloom.plans.storage import spread

#: What counts as a phone number, and as recipient name and mailbox in a To header.
PHONE = r"\+?\d{1,4}?[-.\s]?\(?\d{1,3}?\)?[-.\s]?\d{1,4}[-.\s]?\d{1,5}[-.\s]?\d{2,9}"
TO_NAME = r'^"?([\w\-]+,?(?:\s[\w\-]+)+)'
TO_MAIL = r"<?([_\w\-]+(?:\.?[_\w\-]+)*@[_\w\-]+(?:\.[-_\w]+)+)>?"
SALT = "mailloom"


def phone_numbers(text: Column) -> Column:
    """Distinct phone numbers of a text, in order; digits and blanks of any script count."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit("(?U)" + PHONE), F.lit(0)))


def listed_mailboxes(text: Column, domains: list[str]) -> Column:
    """Distinct mailboxes at any of the domains, or at subdomains; one pass per domain, as one may end another.

    A match begins where a run of its letters does or where the last match ended, so long runs aren't tried from every letter.
    """
    quoted = [d.replace(".", r"\.").replace("-", r"\-") for d in sorted(domains)]
    found = [F.regexp_extract_all(text, F.lit(rf"(?:\G|(?<![-a-zA-Z0-9_.]))[-a-zA-Z0-9_.]+@[-a-zA-Z0-9_.]*{d}"), F.lit(0)) for d in quoted]
    return F.array_distinct(F.flatten(F.array(*found))) if found else F.array().cast("array<string>")


def recipient_words(to: Column) -> Column:
    """Words of the first recipient: of a name of two words at least, the local part of the mailbox and its pieces."""
    name = F.regexp_extract(to, "(?U)" + TO_NAME, 1)
    mail = F.regexp_extract(to, "(?U)" + TO_MAIL, 1)
    local = F.split_part(mail, F.lit("@"), F.lit(1))
    words = F.when(name != "", F.transform(F.split(name, r"\s+"), lambda w: F.rtrim(w, F.lit(",")))).otherwise(F.array().cast("array<string>"))
    names = F.when(mail != "", F.concat(F.array(local), F.split(local, r"\."))).otherwise(F.array().cast("array<string>"))
    return F.filter(F.array_distinct(F.concat(words, names)), lambda w: F.length(w) > 0)


def pseudonym(key: Column, kind: str, salt: str = SALT) -> Column:
    digest = F.substring(F.md5(F.concat(F.lit(salt), F.lower(key)).cast("binary")), 1, 10)
    return {"name": F.concat(F.lit("N"), digest), "email": F.concat(F.lit("u"), digest, F.lit("@example.org")), "phone": F.concat(F.lit("+0"), F.translate(digest, "abcdef", "012345"))}[kind]


def keyed(keys: Column, kind: str, salt: str = SALT) -> Column:
    return F.transform(keys, lambda k: F.struct(k.alias("original"), pseudonym(k, kind, salt).alias("replacement")))


def name_forms(keys: Column, salt: str = SALT) -> Column:
    """A name as it is, capitalised, in lower and in upper case, each with the same pseudonym."""
    forms = F.flatten(F.transform(keys, lambda k: F.array(k, F.concat(F.upper(F.left(k, F.lit(1))), F.lower(F.substring(k, 2, 1 << 20))), F.lower(k), F.upper(k))))
    return keyed(F.array_distinct(forms), "name", salt)


def replacements(text: Column, to: Column, sender: Column, domains: list[str], salt: str = SALT) -> Column:
    """[(original, replacement)] of a mail, longest original first; the recipient counts unless the sender wrote to itself."""
    empty = F.array().cast("array<string>")
    own = F.coalesce(F.when(~to.eqNullSafe(sender), recipient_words(to)), empty)
    mail = F.regexp_extract(to, "(?U)" + TO_MAIL, 1)
    own_mail = F.coalesce(F.when(~to.eqNullSafe(sender) & (mail != ""), F.array(mail)), empty)
    boxes = F.coalesce(listed_mailboxes(text, domains), empty)
    box_words = F.filter(F.flatten(F.transform(boxes, lambda b: F.split(F.split_part(b, F.lit("@"), F.lit(1)), r"\."))), lambda w: F.length(w) > 2)
    pairs = F.concat(keyed(F.array_union(own_mail, boxes), "email", salt), name_forms(F.array_union(own, box_words), salt), keyed(F.coalesce(phone_numbers(text), empty), "phone", salt))
    return F.transform(F.array_sort(F.array_distinct(F.transform(pairs, lambda p: F.struct((-F.length(p.original)).alias("n"), p.original.alias("original"), p.replacement.alias("replacement"))))), lambda p: F.struct(p.original.alias("original"), p.replacement.alias("replacement")))


def replaced(text: Column, pairs: Column) -> Column:
    """All originals replaced, in the order of the pairs; null stays null."""
    return F.aggregate(pairs, text, lambda acc, p: F.replace(acc, p.original, p.replacement))


def anonymized(mails: DataFrame, domains: list[str], salt: str = SALT) -> DataFrame:
    """mails with headers, text parts and raw text under pseudonyms; (mail_id, raw, headers, texts, n_keys, error).

    ``domains`` is the block list, a bounded parameter. Mails with error keep their raw text only
    under pseudonyms of listed mailboxes and phones.
    """
    parts = F.transform("payloads", lambda p: F.struct(p.content_type.alias("kind"), p.content.alias("content"), p.encoding.alias("encoding"), p.charset.alias("charset")))
    d = mails.select("mail_id", "raw", "headers", "payloads", "error", mime.part_texts(parts).alias("texts"))
    everything = F.concat_ws("\n", "raw", F.array_join("texts", "\n"))
    # a shuffle of its own keeps the pairs from being worked out again wherever they are used
    d = d.withColumn("pairs", replacements(everything, F.col("headers")["To"], F.col("headers")["From"], domains, salt))
    d = spread(d, "mail_id")
    d = d.withColumn("texts", F.transform("texts", lambda t: replaced(t, F.col("pairs"))))
    heads = F.transform_values("headers", lambda k, v: replaced(v, F.col("pairs")))
    whole = mime.update_content("raw", "payloads", "texts")
    return d.select("mail_id", replaced(mime.update_headers(whole, heads), F.col("pairs")).alias("raw"), heads.alias("headers"), "texts", F.size("pairs").alias("n_keys"), "error")
