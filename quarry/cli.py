"""Command line: embed, update, watch, search, stats, clear, compact, chat, providers."""

from __future__ import annotations

import argparse

from quarry import encoders
from quarry.engine import Engine
from quarry.operators import config
from quarry.session import session


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quarry")
    p.add_argument("-c", "--config", default="settings.json")
    p.add_argument("--store", default="store")
    p.add_argument("--master", default=None)
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("embed", "update", "stats", "compact", "index", "providers"):
        sub.add_parser(name)
    watch = sub.add_parser("watch")
    watch.add_argument("--interval", type=int, default=60)
    for name in ("search", "chat"):
        s = sub.add_parser(name)
        s.add_argument("question")
        s.add_argument("--top", type=int, default=5)
        if name == "chat":
            s.add_argument("--temperature", type=float, default=None)
            s.add_argument("--max-tokens", type=int, default=None)
    clear = sub.add_parser("clear")
    clear.add_argument("-y", "--yes", action="store_true")
    return p


def run(args: argparse.Namespace, engine: Engine) -> str:
    """What a command prints."""
    if args.command == "embed":
        return str(engine.embed().first().asDict())
    if args.command == "update":
        return str(engine.update())
    if args.command == "watch":
        return str(engine.watch(args.interval))
    if args.command == "search":
        rows = engine.search(args.question, args.top).collect()
        return "\n".join(f"[{i}] {r.similarity_score:.4f} {r.source_id} ({r.chunk_type})" for i, r in enumerate(rows, 1))
    if args.command == "chat":
        if engine.requester:
            api = next(iter(engine.settings.get("generation", {}).get("apis", [])), {})
            return engine.complete([("user", args.question)], args.top, temperature=args.temperature, max_tokens=args.max_tokens, stream=api.get("stream", False), api=api)
        return engine.chat(args.question, args.top)
    if args.command == "stats":
        return str(engine.source_stats().first().asDict(recursive=True))
    if args.command == "clear":
        if not args.yes:
            return "add -y to clear the store"
        engine.clear()
    elif args.command == "compact":
        engine.compact()
    elif args.command == "index":
        engine.index()
    elif args.command == "providers":
        return "\n".join(f"{a['id']}: {a['model']}" for a in engine.providers())
    return "done"


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    settings = config.load(args.config)
    dim = int(settings.get("database", {}).get("vector_dim", 768))
    apis = [config.api_settings(a) for a in settings.get("embedding", {}).get("apis", [])]
    current = settings.get("embedding", {}).get("current_api", "")
    api = next((a for a in apis if a["id"] == current), None)
    encoder = encoders.http_encoder(api["url"], api["key"], int(settings["embedding"].get("batch_size", 4))) if api else encoders.hashing_encoder(dim)
    chats = [config.api_settings(a) for a in settings.get("generation", {}).get("apis", [])]
    requester = encoders.http_requester(chats[0]["url"], chats[0]["key"]) if chats else None
    print(run(args, Engine(session(master=args.master), settings, args.store, encoder, dim, requester=requester, settings_file=args.config)))


if __name__ == "__main__":
    main()
