"""Text: shortening, classes of records, tags, pastes, paths, MIME types."""

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tools by category, in both harnesses' names.
CATEGORIES = {
    "shell": "Bash BashOutput KillShell KillBash",
    "file_read": "Read NotebookRead",
    "file_write": "Write",
    "file_edit": "Edit MultiEdit NotebookEdit",
    "search": "Glob Grep LS",
    "web": "WebFetch WebSearch",
    "agent": "Agent Task",
}
EDITOR_CATEGORIES = {
    "shell": "Shell run_terminal_cmd run_terminal_command",
    "file_read": "Read read_file ReadLints",
    "file_write": "Write write create_file",
    "file_edit": "StrReplace search_replace edit_file MultiEdit EditNotebook apply_patch Delete delete_file",
    "search": "Glob Grep LS list_dir grep_search file_search codebase_search SemanticSearch glob_file_search",
    "web": "WebSearch WebFetch web_search fetch_url",
    "agent": "Task",
}
# Keys of a tool's input that tell most, in order.
ARGUMENTS = "command file_path notebook_path path target_file relative_workspace_path target_directory glob_pattern search_term pattern url query description subagent_type prompt".split()
SUMMARY = "command file_path url pattern description prompt".split()
PATHS = "path file_path target_file relative_workspace_path".split()
# MIME types by first bytes and by extension.
MAGIC = [("89504E470D0A1A0A", "image/png"), ("FFD8FF", "image/jpeg"), ("474946383761", "image/gif"), ("474946383961", "image/gif"), ("255044462D", "application/pdf")]
EXTENSIONS = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp", "pdf": "application/pdf", "txt": "text/plain", "log": "text/plain", "md": "text/markdown", "json": "application/json"}


def strip(s: Column) -> Column:
    """A text without white space of any kind at its ends."""
    return F.regexp_replace(s, r"(?U)^\s+|\s+$", "")


def truncate(s: Column, most: int) -> Column:
    return F.when(F.char_length(s) <= most, s).otherwise(F.concat(F.substring(s, 1, most), F.lit("…")))


def one_line(s: Column, most: int = 80) -> Column:
    t = F.trim(F.regexp_replace(s, r"\s+", " "))
    return F.when(F.char_length(t) > most, F.concat(F.substring(t, 1, most - 1), F.lit("…"))).otherwise(t)


def _category(name: Column, names: dict[str, str], mcp: str) -> Column:
    out = functools.reduce(lambda c, kv: c.when(name.isin(*kv[1].split()), kv[0]), names.items(), F.when(F.lit(False), ""))
    return out.when(name.startswith(mcp), "mcp").otherwise("other")


def category(name: Column) -> Column:
    return _category(name, CATEGORIES, "mcp__")


def base_name(name: Column) -> Column:
    """An editor tool's name without the version at its end."""
    return F.regexp_replace(name, r"_v[0-9]+$", "")


def editor_category(name: Column) -> Column:
    return _category(base_name(name), EDITOR_CATEGORIES, "mcp_")


def json_text(document: Column, key: str) -> Column:
    """A member of a JSON object if it is a string, else null."""
    v = F.try_parse_json(document)
    return F.when(F.schema_of_variant(F.try_variant_get(v, f"$.{key}", "variant")) == "STRING", F.try_variant_get(v, f"$.{key}", "string"))


def first_text(document: Column, keys: list[str]) -> Column:
    return F.coalesce(*(json_text(document, k) for k in keys))


def tool_summary(document: Column) -> Column:
    """What a tool call is about: its most telling argument, else its input, cut short."""
    return truncate(F.coalesce(first_text(document, SUMMARY), truncate(document, 200)), 500)


def chip(document: Column) -> Column:
    """The first argument that is not blank, on one line."""
    texts = [json_text(document, k) for k in ARGUMENTS]
    return F.coalesce(*(F.when(F.length(F.trim(t)) > 0, one_line(t)) for t in texts), F.lit(""))


def call_status(has_result: Column, is_error: Column) -> Column:
    return F.when(~has_result, "no result").when(is_error, "error").otherwise("ok")


def turn_key(role: Column, attributes: Column, own: str = "turn") -> Column:
    """Key of the turn that a record belongs to; an adapter's own key wins."""
    given, message, request = json_text(attributes, own), json_text(attributes, "message.id"), json_text(attributes, "requestId")
    both = F.when(message.isNotNull() | request.isNotNull(), F.concat(F.coalesce(message, F.lit("")), F.lit("|"), F.coalesce(request, F.lit(""))))
    return F.when(role.isin("assistant", "tool"), F.coalesce(given, F.when(role == "assistant", both)))


def content_class(role: Column, text: Column, attributes: Column | None = None, own: str = "content_class") -> Column:
    """What a record is: by role, by the adapter's own class, by the markup at its start, by its flags."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+", "")
    flag = lambda k: F.coalesce(F.get_json_object(attributes, f"$.{k}") == "true", F.lit(False)) if attributes is not None else F.lit(False)
    given = json_text(attributes, own) if attributes is not None else F.lit(None).cast("string")
    begins = lambda *s: functools.reduce(lambda a, b: a | b, (t.startswith(x) for x in s))
    return (
        F.when(role == "assistant", "assistant").when(role == "tool", "tool_result").when(role == "meta", "meta").when(role != "user", "system")
        .when(given.isin("prompt", "injected", "command", "command_output", "caveat", "paste"), given)
        .when(begins("<local-command-caveat>", "Caveat: The messages below were generated by the user while running local commands"), "caveat")
        .when(begins("<command-name>", "<command-message>", "<command-args>"), "command")
        .when(begins("<local-command-stdout>", "<local-command-stderr>"), "command_output")
        .when(flag("isMeta") | flag("isCompactSummary") | begins("<system-reminder>"), "injected")
        .when(t.contains("<pasted_content") & t.contains("</pasted_content>"), "paste")
        .otherwise("prompt")
    )


def _tag(text: Column, name: str) -> Column:
    pattern = f"(?s)<{name}>(.*?)</{name}>"
    return F.when(text.rlike(pattern), strip(F.regexp_extract(text, pattern, 1)))


def command_line(text: Column) -> Column:
    name = F.coalesce(_tag(text, "command-name"), _tag(text, "command-message"), F.lit("command"))
    slashed = F.when(name.startswith("/"), name).otherwise(F.concat(F.lit("/"), name))
    args = _tag(text, "command-args")
    return F.when(F.length(args) > 0, F.concat(slashed, F.lit(" "), args)).otherwise(slashed)


def injected_label(kind: Column, text: Column, attributes: Column) -> Column:
    t = F.regexp_replace(text, r"^\s+", "")
    return (
        F.when(kind == "caveat", "local-command caveat").when(t.startswith("<system-reminder>"), "system reminder")
        .when(F.get_json_object(attributes, "$.isCompactSummary") == "true", "compaction summary")
        .when(t.startswith("Base directory for this skill:") | json_text(attributes, "sourceToolUseID").isNotNull(), "skill")
        .otherwise("harness text")
    )


def split_pastes(text: Column, pattern: str = r"(?s)<pasted_content[^>]*>(.*?)</pasted_content>") -> Column:
    """The parts of a prompt in order, as an array of (paste, text); empty own parts are left out."""
    own, pastes = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), 1)
    own_part = F.transform(own, lambda s: F.struct(F.lit(False).alias("paste"), s.alias("text")))
    paste_part = F.transform(pastes, lambda s: F.struct(F.lit(True).alias("paste"), F.regexp_replace(s, r"^\n", "").alias("text")))
    both = F.flatten(F.transform(own_part, lambda x, i: F.filter(F.array(x, F.try_element_at(paste_part, i + 1)), lambda y: y.isNotNull())))
    return F.filter(both, lambda x: x["paste"] | (F.length(x["text"]) > 0))


def timestamp_desc(what: str, origin: Column) -> Column:
    return (
        F.when(origin == "absent", "No Timestamp").when(origin == "stored", f"{what} (stored)").when(origin == "stored_local_clock", f"{what} (stored, local clock)")
        .when(origin == "file_mtime", "Session File Modified (inferred)").when(origin == "neighbor_interpolated", f"{what} (interpolated, inferred)")
        .otherwise(F.concat(F.lit(f"{what} ("), origin, F.lit(")")))
    )


def source_of(harness: Column) -> Column:
    return F.concat(F.lit("AI:"), F.upper(F.replace(harness, F.lit("-"), F.lit("_"))))


def mime(content: Column, name: Column) -> Column:
    first = F.hex(F.substring(content, 1, 16))
    out = functools.reduce(lambda c, m: c.when(first.startswith(m[0]), m[1]), MAGIC, F.when(F.lit(False), ""))
    out = out.when(first.startswith("52494646") & (F.substring(first, 17, 8) == "57454250"), "image/webp")
    ending = F.lower(F.element_at(F.split(name, r"\."), -1))
    return functools.reduce(lambda c, kv: c.when(ending == kv[0], kv[1]), EXTENSIONS.items(), out).otherwise("application/octet-stream")


def file_uri_path(uri: Column) -> Column:
    """The path of a file:// URI; a drive letter loses the slash before it."""
    p = F.url_decode(F.replace(F.regexp_extract(uri, r"^file://[^/]*(/.*)$", 1), F.lit("+"), F.lit("%2B")))
    return F.when(uri.startswith("file://"), F.regexp_replace(p, r"^/(?=[A-Za-z]:)", ""))


def user_query(text: Column) -> Column:
    """The words inside the wrapper that an editor puts around a prompt; null without one."""
    pattern = r"(?s)<user_query>(.*?)</user_query>"
    return F.when(text.rlike(pattern), strip(F.regexp_extract(text, pattern, 1)))


def unsafe_component(name: Column) -> Column:
    return name.rlike(r"[/\\\x00]") | name.isin("", ".", "..")


def flatten_text(content: Column) -> Column:
    """The text of a message's content: a string itself, or the texts of its parts line by line."""
    v = F.try_parse_json(content)
    whole = F.try_variant_get(v, "$", "string")
    parts = F.filter(F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: F.try_variant_get(x, "$.text", "string")), lambda x: x.isNotNull())
    return F.when(F.schema_of_variant(v) == "STRING", whole).when(F.schema_of_variant(v).startswith("ARRAY"), F.array_join(parts, "\n"))


def join_evidence(folder: Column, tracked: Column) -> Column:
    """The last part of a tracked path within a folder, joined with the mark that parts the folder's own names; both kinds of marks end a name, as evidence may come from any system."""
    last = F.element_at(F.split(tracked, r"[/\\\\]", -1), -1)
    mark = F.when(F.contains(folder, F.lit("\\")) & ~F.contains(folder, F.lit("/")), "\\").otherwise("/")
    return F.concat(F.regexp_replace(folder, r"[/\\\\]+$", ""), mark, F.when(last == "", tracked).otherwise(last))


def mask(secret: Column) -> Column:
    """A secret with all but its first four characters covered."""
    return F.when(F.char_length(secret) <= 4, F.repeat(F.lit("•"), F.char_length(secret))).otherwise(F.concat(F.substring(secret, 1, 4), F.repeat(F.lit("•"), F.char_length(secret) - 4)))
