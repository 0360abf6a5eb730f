"""Chat text: the question inside its wrappers, code blocks, pictures."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import SPACE_CLASS, strip

_S = f"[{SPACE_CLASS}]*"

# Wrappers that chat pages put around a question.
ATTACHED_FILES = rf"(?s)<attached_files>.*?</attached_files>{_S}"
USER_QUERY = rf"(?s)<user_query>{_S}(.*?){_S}</user_query>"
CONTEXT_END = "</context>"
FENCED_CODE = rf"(?s)```(?:python)?{_S}(.*?)```"
DATA_URL = r"(?s)^data:image/([a-zA-Z0-9.+-]+);base64,(.+)$"
# Picture types whose file suffix differs from their name.
PICTURE_SUFFIX = {"jpeg": "jpg", "svg+xml": "svg"}
# Replies for a chat page's own background jobs.
TASK_REPLIES = {
    "query_generation": '{"queries": []}',
    "tags_generation": '{"tags": []}',
    "follow_up_generation": '{"follow_ups": []}',
}
# The title that every chat gets, in the languages of a page; own wording.
TASK_TITLES = {"de": "Auswertung einer Tabelle", "en": "Working with a table"}

PARTS_SCHEMA = "array<struct<type:string,text:string,image_url:string>>"
FILES_SCHEMA = (
    "array<struct<type:string,id:string,name:string,path:string,url:string,"
    "file:struct<id:string,filename:string,path:string,meta:struct<name:string>>>>"
)
FILE_SCHEMA = FILES_SCHEMA[len("array<"):-1]


def bare_question(content: Column) -> Column:
    """The question itself, whatever context was wrapped around it."""
    text = F.regexp_replace(F.coalesce(content, F.lit("")), ATTACHED_FILES, "")
    unwrapped = (
        F.when(text.rlike(USER_QUERY), F.regexp_extract(text, USER_QUERY, 1))
        .when(F.contains(text, F.lit(CONTEXT_END)), F.substring_index(text, CONTEXT_END, -1))
        .otherwise(text)
    )
    return strip(unwrapped)


def text_of_parts(parts: Column) -> Column:
    """Text parts of a message joined by a space."""
    texts = F.transform(
        F.filter(parts, lambda p: p["type"] == "text"), lambda p: F.coalesce(p["text"], F.lit(""))
    )
    return F.array_join(texts, " ")


def message_text(content: Column) -> Column:
    """Content that is either plain text or a JSON array of parts."""
    parts = F.from_json(content, PARTS_SCHEMA)
    is_list = F.startswith(content, F.lit("[{")) & parts.isNotNull()
    return F.when(is_list, text_of_parts(parts)).otherwise(content)


def code_block(reply: Column) -> Column:
    """Inside of the first fenced code block; null when there is none."""
    return F.when(reply.rlike(FENCED_CODE), strip(F.regexp_extract(reply, FENCED_CODE, 1)))


def task_reply(task: Column, language: str = "de") -> Column:
    """Canned reply for a background job, '' for an unknown one."""
    title = TASK_TITLES.get(language, TASK_TITLES["de"])
    replies = {**TASK_REPLIES, "title_generation": f'{{"title": "{title}"}}'}
    reply = F.lit("")
    for name, text in replies.items():
        reply = F.when(task == name, F.lit(text)).otherwise(reply)
    return reply


def picture_urls(parts: Column, files: Column) -> Column:
    """URLs of pictures in message parts, then those listed as files."""
    in_parts = F.transform(
        F.filter(parts, lambda p: p["type"] == "image_url"),
        lambda p: F.coalesce(F.get_json_object(p["image_url"], "$.url"), p["image_url"]),
    )
    listed = F.transform(
        F.filter(files, lambda f: (f["type"] == "image") & f["url"].isNotNull()), lambda f: f["url"]
    )
    none = F.array().cast("array<string>")
    return F.concat(F.coalesce(in_parts, none), F.coalesce(listed, none))


def decode_base64(text: Column) -> Column:
    """Base64 to bytes; foreign characters are skipped, wrong padding gives null."""
    kept = F.regexp_replace(text, "[^A-Za-z0-9+/=]", "")
    padded = F.regexp_extract(
        kept, r"^((?:[A-Za-z0-9+/]{4})*+(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)).*$", 1
    )
    whole = F.when(padded != "", padded).when(kept.rlike(r"^(?:[A-Za-z0-9+/]{4})*+$"), kept)
    return F.try_to_binary(whole, F.lit("base64"))


def pictures(urls: Column) -> Column:
    """Array of (name, content) for the URLs that hold a decodable picture."""
    def one(url: Column) -> Column:
        u = strip(url)
        kind = F.lower(F.regexp_extract(u, DATA_URL, 1))
        for name, suffix in PICTURE_SUFFIX.items():
            kind = F.when(kind == name, F.lit(suffix)).otherwise(kind)
        return F.struct(
            kind.alias("suffix"),
            F.when(u.rlike(DATA_URL), decode_base64(F.regexp_extract(u, DATA_URL, 2))).alias("content"),
        )

    found = F.filter(F.transform(urls, one), lambda p: p["content"].isNotNull())
    return F.transform(
        found,
        lambda p, i: F.struct(
            F.concat(F.lit("bild_"), (i + 1).cast("string"), F.lit("."), p["suffix"]).alias("name"),
            p["content"].alias("content"),
        ),
    )


def file_ref(entry: Column) -> Column:
    """(id, name, path) of an attached file; null for entries that are none."""
    info = entry["file"]
    ident = F.coalesce(F.nullif(info["id"], F.lit("")), F.nullif(entry["id"], F.lit("")))
    name = F.coalesce(
        F.nullif(info["filename"], F.lit("")), F.nullif(entry["name"], F.lit("")), info["meta"]["name"]
    )
    path = F.coalesce(F.nullif(info["path"], F.lit("")), entry["path"])
    has_info = F.coalesce(info["id"], info["filename"], info["path"], info["meta"]["name"]).isNotNull()
    kind = entry["type"]
    ok = (
        (kind.isNull() | kind.isin("file", "image"))
        & ident.isNotNull()
        & name.isNotNull()
        & (name != "")
        & ((F.coalesce(kind, F.lit("file")) != "image") | has_info)
    )
    return F.when(ok, F.struct(ident.alias("id"), name.alias("name"), path.alias("path")))
