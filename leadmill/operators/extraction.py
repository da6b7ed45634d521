"""Contacts and signals of HTML pages, as native expressions over whole pages.

Fifteen generators run in a fixed order; the first evidence of a (type, value)
wins, so the order decides the confidence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadmill.functions import text as T
from leadmill.operators.folds import ordered_union

EVIDENCE = "struct<type: string, value: string, raw: string, confidence: double, label: string>"
#: Words in a path that tell a page's type, in order.
PAGE_TYPES = (
    ("contact", ("contato", "contact", "fale", "atendimento", "suporte", "sac")), ("privacy", ("politica", "privacy")), ("terms", ("termos", "terms")),
    ("about", ("sobre", "about", "empresa", "institucional", "quem", "historia")),
)


def visible_text(html: Column) -> Column:
    """Text between tags, one line per piece, without scripts and styles."""
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", "\n"), r"<[^>]*>", "\n")
    for entity, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&#64;", "@"), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(plain))
    return F.trim(F.regexp_replace(bare, r"[ \t]*\n\s*", "\n"))


def absolute(href: Column, base: Column) -> Column:
    """A link made absolute against the page's URL, fragment off."""
    root, folder = F.regexp_extract(base, "^([^/]*://[^/?#]*)", 1), F.regexp_extract(base, "^([^/]*://[^?#]*/|[^/]*://[^/?#]*)", 1)
    link = F.regexp_replace(F.trim(href), "#.*$", "")
    scheme = F.regexp_extract(base, "^([^/]*:)//", 1)
    return (
        F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), link).when(link.startswith("//"), F.concat(scheme, link)).when(link.startswith("/"), F.concat(root, link))
        .when(link == "", base).when(link.startswith("?"), F.concat(F.regexp_replace(base, r"[?#].*$", ""), link)).otherwise(F.concat(F.regexp_replace(folder, "/?$", "/"), link))
    )


def _listed(values: Column, kind: str, confidence: float, label: str | None = None, raw=None) -> Column:
    return F.transform(values, lambda v: F.named_struct(F.lit("type"), F.lit(kind), F.lit("value"), v, F.lit("raw"), raw(v) if raw else v, F.lit("confidence"), F.lit(confidence), F.lit("label"), F.lit(label).cast("string")))


def evidence(pages: DataFrame, url: str = "url", html: str = "html", key: str = "page_id") -> DataFrame:
    """Key, pos, type, value, raw, confidence and label of every evidence of a page."""
    base = pages.select(F.col(key), F.coalesce(F.col(url), F.lit("")).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    base = base.withColumn("text", visible_text(F.col("html")))
    pattern = r"(?is)<a\b[^>]*?\bhref\s*=\s*[\"']([^\"']*)[\"'][^>]*>(.*?)</a>"
    pull = lambda c, p, g: F.regexp_extract_all(c, F.lit(p), F.lit(g))
    base = base.withColumn("hrefs", F.transform(pull(F.col("html"), pattern, 1), lambda x: F.trim(x))).withColumn("names", F.transform(pull(F.col("html"), pattern, 2), lambda x: F.trim(F.regexp_replace(x, "<[^>]*>", " "))))
    pairs = F.arrays_zip("hrefs", "names")
    starts = lambda p, word: F.lower(p["hrefs"]).startswith(word)
    plain = F.filter(pairs, lambda p: ~starts(p, "mailto:") & ~starts(p, "tel:"))
    links = F.transform(plain, lambda p: F.named_struct(F.lit("u"), absolute(p["hrefs"], F.col("url")), F.lit("n"), p["names"]))
    base = base.withColumn("links", links).withColumn("tels", F.transform(F.filter(pairs, lambda p: starts(p, "tel:")), lambda p: F.named_struct(F.lit("u"), T.phone_br(F.substring_index(p["hrefs"], ":", -1)), F.lit("n"), p["names"])))
    mails = F.flatten(F.transform(F.filter("hrefs", lambda h: F.lower(h).startswith("mailto:")), lambda h: T.emails(F.substring_index(F.regexp_replace(h, "(?i)^mailto:", ""), "?", 1))))
    tel = lambda only: F.array_compact(F.transform(F.filter("tels", lambda t: F.contains(F.lower(t["n"]), F.lit("whatsapp")) if only else F.lit(True)), lambda t: t["u"]))
    chat = F.array_compact(F.transform("links", lambda k: T.whatsapp_of(k["u"])))
    contact = F.transform(F.filter("links", lambda k: F.coalesce(T.url_has_hint(k["u"], k["n"]), F.lit(False))), lambda k: k["u"])
    hidden = F.array_compact(F.transform(pull(F.col("html"), r"(?i)data-cfemail\s*=\s*[\"']([0-9a-f]+)[\"']", 1), T.protected_email))
    spoken = F.flatten(F.transform(F.filter(F.split("text", "\n"), lambda x: F.contains(F.lower(x), F.lit("whatsapp"))), T.phones))
    photo = T.instagram_links(F.transform("links", lambda k: k["u"]))
    forms = F.transform(pull(F.col("html"), r"(?is)<form\b([^>]*)>", 1), lambda f: absolute(F.regexp_extract(f, r"(?i)\baction\s*=\s*[\"']([^\"']*)[\"']", 1), F.col("url")))
    found = F.concat(
        _listed(mails, "email", 0.98, "mailto"), _listed(tel(False), "phone", 0.96, "tel"), _listed(tel(True), "whatsapp", 0.88, "tel whatsapp"),
        _listed(chat, "whatsapp", 0.99, "whatsapp_link"), _listed(contact, "contact_form", 0.55, "contact_link"), _listed(hidden, "email", 0.9, "protected"),
        _listed(T.emails(F.col("text")), "email", 0.92), _listed(T.spaced_emails(F.col("text")), "email", 0.9, "spaced_text"),
        _listed(T.emails(F.col("html")), "email", 0.88, "source"), _listed(T.spaced_emails(F.col("html")), "email", 0.86, "spaced_source"),
        _listed(T.obfuscated_emails(F.col("text")), "email", 0.82, "obfuscated"), _listed(T.phones(F.col("text")), "phone", 0.78),
        _listed(spoken, "whatsapp", 0.86, "whatsapp_text"), _listed(photo, "instagram", 0.93), _listed(forms, "contact_form", 0.84, "form"),
    )
    rows = base.select(key, F.posexplode(found).alias("pos", "e")).select(key, "pos", "e.*").where("value is not null")
    first = rows.groupBy(key, "type", "value").agg(F.min(F.struct("pos", "raw", "confidence", "label")).alias("f"))
    return first.select(key, "f.pos", "type", "value", "f.raw", "f.confidence", "f.label")


def confidence_by_type(found: DataFrame, key: str = "page_id") -> DataFrame:
    """The greatest confidence of each type of a page."""
    return found.groupBy(key, "type").agg(F.max("confidence").alias("confidence"), F.count("*").alias("n"))


def page_type(url: Column, home: Column) -> Column:
    """Homepage, or the first type with a word in the path."""
    path = F.lower(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1))
    strip = lambda c: F.regexp_replace(c, "/+$", "")
    out = F.when(strip(url) == strip(home), "homepage")
    for name, words in PAGE_TYPES:
        out = out.when(path.rlike("|".join(words)), name)
    return out.otherwise("website_page")


def merged_signals(pages: DataFrame, host: Column, html: str = "html") -> DataFrame:
    """For each host and signal whether any page shows it, the best confidence and how many pages do."""
    plain = pages.select(host.alias("host"), T.normalize_text(visible_text(F.col(html))).alias("t"))
    each = plain.select("host", *[c.alias(k) for k, c in T.signals(F.col("t")).items()])
    rows = each.select("host", F.explode(F.array(*[F.struct(F.lit(k).alias("signal"), F.size(k).alias("n"), T.signal_confidence(F.col(k)).alias("confidence")) for k in T.SIGNALS])).alias("s"))
    return rows.groupBy("host", "s.signal").agg(F.max(F.col("s.n") > 0).alias("relevant"), F.max("s.confidence").alias("confidence"), F.count_if(F.col("s.n") > 0).alias("pages"))


def merged_signal_words(pages: DataFrame, host: Column, place: Column, html: str = "html") -> DataFrame:
    """For each host and signal that any page shows, its words as an ordered union over the pages in order of place."""
    plain = pages.select(host.alias("host"), place.alias("page_place"), T.normalize_text(visible_text(F.col(html))).alias("t"))
    each = plain.select("host", "page_place", *[c.alias(k) for k, c in T.signals(F.col("t")).items()])
    rows = each.select("page_place", F.explode(F.array(*[F.struct(F.struct("host", F.lit(k).alias("signal")).alias("of"), F.col(k).alias("words")) for k in T.SIGNALS])).alias("s")).select("page_place", "s.*")
    return ordered_union(rows, "of", F.col("page_place"), F.col("words"), "words").select("of.host", "of.signal", "words")
