"""Derived WARC records: metadata and plain-text conversions of response records.

Records are rows of fields and bytes. A response gives one metadata and one conversion record; both refer to it by
its record id and carry its target and date, the digest of its payload and its HTTP headers. The text comes from
the HTML by rules: comments, scripts, styles and heads go, block elements end lines, entities are decoded.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CRLF = "\r\n"
#: The date of records whose source has none.
DATE = "1970-01-01T00:00:00Z"

_OPEN = re.compile(r"<!--|<!\[CDATA\[|<(script|style|noscript|template|svg|head)(?=[\s/>])", re.I)
_COMMENT_END = re.compile(r"-?>|.*?(?:--!?>|\Z)", re.S)
#: A slash after a space, a quoted value or the name; one that ends an unquoted value is part of it.
_EMPTY = re.compile(r"<\w+(?:\s[^>]*[\s\"'])?/>")
_END = {k: re.compile(rf"</{k}\s*>", re.I) for k in ("script", "style", "noscript", "template", "svg")}
#: What a head holds after its tag; text or any other element ends it, as its end tag may be left out.
_HEAD = re.compile(r"(?:\s+|<!--(?:-?>|.*?(?:--!?>|\Z))|</?(?:meta|link|base|basefont|bgsound)(?=[\s/>])[^>]*>|<(?:title|style|script|noscript|template)(?:\s[^>]*[\s\"'])?/>|<(title|style|script|noscript|template)(?=[\s/>])[^>]*>.*?</\1\s*>)*(?:</head\s*>)?", re.S | re.I)
_BLOCK = re.compile(r"</?(?:p|div|br|hr|li|ul|ol|dl|dt|dd|tr|table|thead|tbody|h[1-6]|section|article|header|footer|nav|aside|main|figure|figcaption|form|fieldset|blockquote|pre|address|option|select|title|body|html)\b[^>]*>", re.I)
_TAG = re.compile(r"</?[a-zA-Z!?][^>]*>")
_GAPS = re.compile(r"[ \t\r\f\v ]+")
_TITLE, _TITLE_END = re.compile(r"<title\b[^>]*>", re.I), re.compile(r"</title\s*>", re.I)
_LANG = re.compile(r"<html\b[^>]*\blang\s*=\s*[\"']?([\w-]+)", re.I)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts) -> str:
    """The same id whenever the same source is built again."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(0).join(map(str, parts)))}>"


def without_hidden(page: str) -> str:
    """The page without comments, scripts, styles, heads and the like. Only comments, scripts and styles run to the page's end if nothing ends them."""
    out, at, open_ended, last = [], 0, set(), page.rfind(">")
    while m := _OPEN.search(page, at):
        kind, past = (m[1] or "").lower(), m.end()
        if kind and past > last:
            # no tag ends from here on
            out.append(page[at:past])
            at = past
            continue
        tag = page[m.start() : (past := page.find(">", past) + 1)] if kind else ""
        if m[0] == "<!--":
            past = _COMMENT_END.match(page, past).end()
        elif not kind:
            if "cdata" not in open_ended and (end := page.find("]]>", past)) >= 0:
                past = end + 3
            else:
                open_ended.add("cdata")
        elif kind == "head":
            # a page has one; the tag of another says nothing
            if kind not in open_ended:
                past = _HEAD.match(page, past).end()
            open_ended.add(kind)
        elif not _EMPTY.fullmatch(tag) and kind not in open_ended:
            if end := _END[kind].search(page, past):
                past = end.end()
            elif kind in ("script", "style"):
                past = len(page)
            else:
                open_ended.add(kind)
        out += [page[at : m.start()], "\n" if kind else ""]
        at = past
    return "".join([*out, page[at:]])


def plain_text(page: str) -> str:
    s = without_hidden(page).replace("\n", " ")
    # past the last > there is no tag
    k = s.rfind(">") + 1
    s = html.unescape(_TAG.sub("", _BLOCK.sub("\n", s[:k])) + s[k:])
    lines = (_GAPS.sub(" ", x).strip() for x in s.split("\n"))
    return "\n".join(x for x in lines if x)


def build(kind: str, fields: dict, block: bytes) -> bytes:
    head = {"WARC-Type": kind, **{k: v for k, v in fields.items() if v}, "WARC-Block-Digest": digest(block), "Content-Length": str(len(block))}
    return ("WARC/1.1" + CRLF + "".join(f"{k}: {v}{CRLF}" for k, v in head.items()) + CRLF).encode() + block + (CRLF * 2).encode()


def parse(record: bytes) -> tuple[dict, bytes]:
    """Header fields (names in lower case) and block of one record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split(CRLF)
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if ":" in x)}
    return fields, rest[: int(fields.get("content-length", len(rest)))]


def response(url: str | None, page: str | None, date: str = DATE) -> bytes:
    payload = (page or "").encode()
    http = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: {len(payload)}{CRLF}{CRLF}".encode()
    url = re.sub(r"[\r\n]", "", url or "")
    return build("response", {"WARC-Record-ID": record_id("response", url, digest(payload)), "WARC-Target-URI": url, "WARC-Date": date, "WARC-Payload-Digest": digest(payload), "Content-Type": "application/http; msgtype=response"}, http + payload)


def derive(record: bytes) -> dict:
    """The metadata and conversion records of a response record, with the fields that link them."""
    fields, block = parse(record)
    http, _, payload = block.partition(b"\r\n\r\n")
    status, *headers = http.decode("latin-1").split(CRLF)
    # in order, with all of a repeated name
    http_fields = [(k.strip().lower(), v.strip()) for k, _, v in (h.partition(":") for h in headers)]
    charset = re.search(r"charset=([\w-]+)", dict(http_fields).get("content-type", ""))
    try:
        page = payload.decode(charset[1] if charset else "utf-8", "replace")
    except LookupError:
        page = payload.decode("utf-8", "replace")
    source, target, date = fields.get("warc-record-id", ""), fields.get("warc-target-uri", ""), fields.get("warc-date", DATE)
    payload_digest = digest(payload)
    common = {"WARC-Target-URI": target, "WARC-Date": date, "WARC-Refers-To": source, "WARC-Refers-To-Target-URI": target, "WARC-Refers-To-Date": date}
    text = plain_text(page)
    last = page.rfind(">") + 1
    opened, lang = _TITLE.search(page, 0, last), _LANG.search(page, 0, last)
    closed = _TITLE_END.search(page, opened.end()) if opened else None
    title = page[opened.end() : closed.start()] if closed else ""
    facts = [("http-status", status), *((f"http-{k}", v) for k, v in http_fields), ("source-payload-digest", payload_digest), ("title", _GAPS.sub(" ", html.unescape(title)).replace("\n", " ").strip()), ("html-lang", lang[1] if lang else ""), ("text-length", str(len(text)))]
    meta_block = "".join(f"{k}: {v}{CRLF}" for k, v in facts if v).encode()
    meta_id, text_id = record_id("metadata", source), record_id("conversion", source)
    meta = build("metadata", {"WARC-Record-ID": meta_id, **common, "Content-Type": "application/warc-fields"}, meta_block)
    conv = build("conversion", {"WARC-Record-ID": text_id, **common, "WARC-Payload-Digest": payload_digest, "Content-Type": "text/plain; charset=utf-8"}, text.encode())
    return {"response_id": source, "target_uri": target, "payload_digest": payload_digest, "metadata_id": meta_id, "metadata": meta, "conversion_id": text_id, "conversion": conv, "text": text, "text_digest": digest(text.encode())}


FIELDS = ["response_id", "target_uri", "payload_digest", "metadata_id", "metadata", "conversion_id", "conversion", "text", "text_digest"]
SCHEMA = "page_id long, response_id string, target_uri string, payload_digest string, metadata_id string, metadata binary, conversion_id string, conversion binary, text string, text_digest string"


def derive_records(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html", record: str | None = None) -> DataFrame:
    """One row per input row: ids, links, digests, text, and the bytes of both derived records.

    With `record` that column holds response records as bytes; otherwise responses are built of url and page. Null
    pages are empty payloads and give empty text, null urls no target; repeated rows get equal ids. Nothing is shuffled.
    """
    kept = [F.col(page_id).cast("long").alias("page_id"), *([F.col(record).alias("record")] if record else [F.col(url).alias("url"), F.col(page).alias("page")])]

    def run(frames):
        for pdf in frames:
            made = [derive(bytes(r) if r is not None else b"") for r in pdf["record"]] if record else [derive(response(u, p)) for u, p in zip(pdf["url"], pdf["page"])]
            yield pd.DataFrame({"page_id": pdf["page_id"], **{k: [m[k] for m in made] for k in FIELDS}})

    return pages.select(*kept).mapInPandas(run, SCHEMA)


def write_records(derived: DataFrame, path: str) -> None:
    """Both records of each row as WARC files: they are UTF-8, and each ends in the blank lines that the writer adds."""
    both = derived.select(F.explode(F.array("metadata", "conversion")).alias("r"))
    both.select(F.expr("substr(cast(r as string), 1, length(cast(r as string)) - 4)").alias("value")).write.option("lineSep", CRLF * 2).option("compression", "gzip").text(path)


def op6_warc_derivatives(spark, sf_dir: str) -> DataFrame:
    out = derive_records(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.select("page_id", "response_id", "target_uri", "payload_digest", "metadata_id", F.sha2("metadata", 256).alias("metadata_sha256"), "conversion_id", F.sha2("conversion", 256).alias("conversion_sha256"), F.length("text").alias("n_chars"), "text_digest")
