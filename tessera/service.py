"""The request/response layer: JSON-RPC lines and hook events, over a Palace."""

from __future__ import annotations

import json
import re
import time

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.functions.vector import VERSION
from tessera.palace import Palace

PROTOCOL = "2024-11-05"


def _tool(name: str, description: str, required: list[str], **properties: tuple[str, str]) -> dict:
    schema = {"type": "object", "properties": {k: {"type": t, "description": d} for k, (t, d) in properties.items()}}
    return {"name": name, "description": description, "inputSchema": schema | ({"required": required} if required else {})}


TOOLS = [
    _tool("memory_search", "Find stored texts by meaning and keywords.", ["query"], query=("string", "What to look for."), limit=("integer", "Results at most (default 5).")),
    _tool("memory_store", "Store a text as it is.", ["content"], content=("string", "The text."), wing=("string", "Its project."), room=("string", "Its topic (default: notes).")),
    _tool("memory_wake_up", "A digest of the newest texts.", [], wing=("string", "Only of this project.")),
    _tool("memory_stats", "How many wings, rooms, drawers and entities there are.", []),
]


class ToolError(Exception):
    """Its message is the error's name."""


def get_str(args, key: str) -> str | None:
    value = args.get(key) if isinstance(args, dict) else None
    return value if isinstance(value, str) and value else None


def get_int(args, key: str) -> int | None:
    value = args.get(key) if isinstance(args, dict) else None
    if isinstance(value, bool):
        return None
    if isinstance(value, (int, float)):
        return int(value) if abs(value) <= 1e18 else None
    return int(value) if isinstance(value, str) and re.fullmatch(r"[-+]?[0-9]{1,18}", value) else None


def stats_text(row) -> str:
    return "\n".join(f"{name.capitalize() + ':':<10}{row[name]:>8}" for name in ("wings", "rooms", "drawers", "entities"))


class Service:
    def __init__(self, palace: Palace, default_wing: str = "default", now=time.time):
        self.palace, self.default_wing, self.now = palace, default_wing, lambda: int(now())

    def handle_rpc(self, line: str) -> str | None:
        """The answer to one line, or None: to a notification, and to a line that is no request."""
        try:
            request = json.loads(line)
            method, params, ident = request["method"], request.get("params"), request.get("id")
        except (ValueError, TypeError, KeyError, AttributeError):
            return None
        if method == "notifications/initialized":
            return None
        if method == "initialize":
            asked = get_str(params, "protocolVersion")
            version = asked if asked and re.fullmatch(r"[0-9.-]{1,32}", asked) else PROTOCOL
            result = {"protocolVersion": version, "capabilities": {"tools": {}}, "serverInfo": {"name": "tessera", "version": VERSION}}
        elif method == "ping":
            result = {}
        elif method == "tools/list":
            result = {"tools": TOOLS}
        elif method == "tools/call":
            try:
                said = self.call(params)
            except Exception as e:  # noqa: BLE001  an error is an answer
                said = f"Error: {e if isinstance(e, ToolError) else type(e).__name__}"
            result = {"content": [{"type": "text", "text": said}], "isError": False}
        else:
            return self._line({"jsonrpc": "2.0", "id": ident, "error": {"code": -32601, "message": "method not found"}})
        return self._line({"jsonrpc": "2.0", "id": ident, "result": result})

    @staticmethod
    def _line(answer: dict) -> str:
        return json.dumps(answer, ensure_ascii=False, separators=(",", ":"))

    def call(self, params) -> str:
        if not isinstance(params, dict):
            raise ToolError("MissingParams")
        name, args = params.get("name"), params.get("arguments")
        if not isinstance(name, str):
            raise ToolError("MissingToolName")
        if name == "memory_search":
            limit = get_int(args, "limit")
            return self.search_text(self._need(args, "query", "MissingQuery"), 5 if limit is None else min(max(limit, 1), 100))
        if name == "memory_store":
            content = self._need(args, "content", "MissingContent")
            wing, room = get_str(args, "wing") or self.default_wing, get_str(args, "room") or "notes"
            return f"Stored memory #{self.palace.store(content, wing, room, now=self.now())} in {wing}/{room}."
        if name == "memory_wake_up":
            return self.palace.wake_up(get_str(args, "wing"))
        if name == "memory_stats":
            return stats_text(self.palace.stats().head())
        return f"Unknown tool: {name}"

    @staticmethod
    def _need(args, key: str, error: str) -> str:
        if (value := get_str(args, key)) is None:
            raise ToolError(error)
        return value

    def search_text(self, query: str, limit: int) -> str:
        rows = self.palace.search(query, limit, now=self.now()).collect()
        if not rows:
            return "No relevant memories found."
        blocks = [f"{i}. [{r.wing_name}/{r.room_name}] {r.source_path}\n{r.content}\n\n" for i, r in enumerate(rows, 1)]
        return f"Found {len(rows)} relevant memor{'y' if len(rows) == 1 else 'ies'}:\n\n" + "".join(blocks)

    def process_hook(self, event: dict) -> dict:
        """The answer to a hook event: the digest when a session starts; before a compaction the transcript's tail is stored."""
        if not isinstance(event, dict):
            return {}
        name = (get_str(event, "hook_event_name") or get_str(event, "hook") or "unknown").lower()
        route = next((e for e, spellings in text.EVENTS.items() if name in spellings), "unknown")
        if route == "SessionStart":
            return {"hookSpecificOutput": {"hookEventName": "SessionStart", "additionalContext": self.palace.wake_up()}}
        if route == "PreCompact" and (path := get_str(event, "transcript_path")):
            self.save_transcript(path)
        return {}

    def save_transcript(self, path: str) -> None:
        """Store the tail of a transcript (JSON lines); one that can't be read is left alone."""
        spark = self.palace.spark
        doc = F.try_parse_json("value")
        at = lambda p: F.try_variant_get(doc, p, "string")
        content = F.to_json(F.try_variant_get(doc, "$.message.content", "variant"))
        try:
            lines = spark.read.text(path).select(F.lit(0).alias("key"), F.monotonically_increasing_id().alias("place"), "value")
            rows = lines.select("key", "place", text.role(at("$.type"), at("$.message.role")).alias("role"), text.content_text(content).alias("body"))
            found = text.transcript_tail(rows, ["key"], ["place"], "role", "body").head()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return
        if found:
            self.palace.store(found["content"], self.default_wing, "sessions", "precompact-autosave", now=self.now())
