"""Lookups over HTTP: start one, poll its snapshots, open a row, add records, choose people, read on.

A thin layer over ``streaming.jobs``: the handler checks requests and answers JSON, and
a factory that the caller gives makes the jobs.
"""

from __future__ import annotations

import gzip
import json
import mimetypes
import posixpath
import sys
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path
from urllib.parse import parse_qs, unquote, urlparse

from folioforge.streaming.jobs import Job, Registry

# Limits of a request, and from which size an answer is packed.
MOST_VARIANTS, LONGEST_VARIANT, LARGEST_BODY, PACK_FROM = 12, 300, 64 * 1024, 1024


class BadRequest(ValueError):
    """What a client got wrong."""


def question(fields: dict, query: dict[str, list[str]]) -> dict:
    """A question of a JSON body, or else of the query string, checked."""
    said = lambda name: str(fields.get(name) or (query.get(name) or [""])[0]).strip()
    asked = {"title": said("title"), "author": said("author")}
    if not any(asked.values()):
        raise BadRequest("give a title and an author")
    variants = fields.get("variants") or []
    if not isinstance(variants, list) or len(variants) > MOST_VARIANTS or any(not isinstance(v, str) or not 0 < len(v) <= LONGEST_VARIANT for v in variants):
        raise BadRequest(f"variants are up to {MOST_VARIANTS} other spellings of the title")
    asked["variants"] = [v.strip() for v in variants]
    for name in ("title_spellings", "author_spellings"):
        asked[name] = fields.get(name, False)
        if not isinstance(asked[name], bool):
            raise BadRequest(f"{name} is true or false")
    return asked


def handler(registry: Registry, make: Callable[[dict], Job], details: Callable[[Job, str], dict | None], root: Path | None = None) -> type[BaseHTTPRequestHandler]:
    """The request handler of a registry; ``details`` gives one row in full, None if the job has no such row."""

    class Handler(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def send(self, payload: dict, status: int = 200) -> None:
            body = json.dumps(payload, ensure_ascii=False, default=str).encode()
            packed = len(body) >= PACK_FROM and "gzip" in (self.headers.get("Accept-Encoding") or "")
            self.reply(gzip.compress(body) if packed else body, "application/json; charset=utf-8", status, {"Content-Encoding": "gzip"} if packed else {})

        def reply(self, body: bytes, kind: str, status: int = 200, more: dict[str, str] | None = None) -> None:
            self.send_response(status)
            for name, value in ({"Content-Type": kind, "Content-Length": str(len(body))} | (more or {})).items():
                self.send_header(name, value)
            self.end_headers()
            if self.command != "HEAD":
                self.wfile.write(body)

        def log_message(self, form: str, *args) -> None:
            print(f"{self.address_string()} {form % args}", file=sys.stderr)

        def body(self) -> dict:
            size = int(self.headers.get("Content-Length") or 0)
            if size > LARGEST_BODY:
                self.close_connection = True
                raise BadRequest(f"request body over {LARGEST_BODY} bytes")
            raw = self.rfile.read(size) if size else b""
            try:
                fields = json.loads(raw.decode()) if raw else {}
            except ValueError:
                raise BadRequest("the body is not JSON") from None
            if not isinstance(fields, dict):
                raise BadRequest("the body is not a JSON object")
            return fields

        def guarded(self, act: Callable[[list[str], dict], None]) -> None:
            """One request's failure is its answer, never the server's end."""
            url = urlparse(self.path)
            try:
                registry.sweep()
                act([unquote(p) for p in url.path.strip("/").split("/")], parse_qs(url.query))
            except BadRequest as e:
                self.send({"error": str(e)}, 400)
            except LookupError as e:
                self.send({"error": str(e.args[0] if e.args else e)}, 400)
            except RuntimeError as e:
                self.send({"error": str(e)}, 409)
            except (BrokenPipeError, ConnectionResetError):
                pass
            except Exception as e:  # noqa: BLE001
                self.send({"error": f"{type(e).__name__}: {e}"}, 500)

        def do_POST(self) -> None:  # noqa: N802
            self.guarded(self.post)

        def do_GET(self) -> None:  # noqa: N802
            self.guarded(self.get)

        do_HEAD = do_GET  # noqa: N815

        def post(self, parts: list[str], query: dict) -> None:
            fields = self.body()
            if parts == ["lookup"]:
                key = registry.start(job := make(question(fields, query)))
                return self.accepted(key, job, 0)
            if len(parts) == 3 and parts[0] == "lookup":
                job = registry.get(parts[1])
                if job is None:
                    return self.send({"error": "no such job", "id": parts[1]}, 404)
                if parts[2] in ("add", "choose"):
                    return self.picked(job, parts[2], fields)
                if parts[2] == "more":
                    return self.more(job)
            self.send({"error": "no such address"}, 404)

        def accepted(self, key: str, job: Job, version: int) -> None:
            self.send({"id": key, "version": version, "poll": f"/lookup/{key}?v={version}"}, 202)

        def picked(self, job: Job, what: str, fields: dict) -> None:
            name = "keys" if what == "add" else "ids"
            chosen = fields.get(name)
            if not isinstance(chosen, list) or not chosen or not all(isinstance(x, str) and x for x in chosen):
                raise BadRequest(f"give a list of {name}")
            if what == "add":
                append = job.question.get("append")
                if append is None:
                    raise RuntimeError("nothing can be added to this lookup")
                return self.send({"id": job.id, "version": job.add(lambda j: append(j, chosen))})
            if not hasattr(job, "choose") or job.stage != "choosing":
                raise RuntimeError("this lookup is not waiting for a choice")
            job.choose(chosen, registry.pool)
            self.accepted(job.id, job, job.version)

        def more(self, job: Job) -> None:
            read = job.question.get("read_rest")
            if read is None:
                raise RuntimeError("only an author lookup reads under a name")
            job.add(read)
            self.accepted(job.id, job, job.version)

        def get(self, parts: list[str], query: dict) -> None:
            if parts == ["health"]:
                return self.send({"ok": True, "jobs": len(registry)})
            if parts[0] != "lookup" or len(parts) < 2:
                return self.static(parts)
            job = registry.get(parts[1])
            if job is None:
                return self.send({"error": "no such job", "id": parts[1]}, 404)
            if len(parts) == 4 and parts[2] == "edition":
                found = details(job, parts[3])
                return self.send(found if found is not None else {"error": "no such edition in this lookup", "id": parts[3]}, 200 if found is not None else 404)
            held = (query.get("v") or ["0"])[0]
            self.send(job.since(int(held) if held.isdigit() else 0))

        def static(self, parts: list[str]) -> None:
            """A file of the page's folder, and nothing above it."""
            name = posixpath.normpath("/".join(parts) or "index.html").lstrip("/")
            file = (root / name).resolve() if root is not None else None
            if file is None or not file.is_relative_to(root.resolve()) or not file.is_file():
                return self.send({"error": "not found"}, 404)
            self.reply(file.read_bytes(), mimetypes.guess_type(file.name)[0] or "application/octet-stream")

    return Handler


def serve(registry: Registry, make: Callable[[dict], Job], details: Callable[[Job, str], dict | None], port: int = 8000, root: Path | None = None) -> ThreadingHTTPServer:
    """A server on the local host, ready to ``serve_forever``."""
    try:
        return ThreadingHTTPServer(("127.0.0.1", port), handler(registry, make, details, root))
    except OSError as e:
        raise SystemExit(f"port {port} can't be used: {e}") from None
