"""Commands: index, search, show, status, check, rm, version. Exit codes: 0, 1 failure, 2 usage, 3 stale."""

from __future__ import annotations

import argparse
import json
import os
import signal
import sys
import threading

from .api import ANSWER_SCHEMA, Engine, find
from .plans.index import IndexError_
from .session import local_session
from .sources.embed import EmbedError, HttpEmbedder
from .sources.listing import INDEX_DIR, MAX_SIZE, NOISY, Rules

VERSION = "0.1.0"

#: Messages in English and Russian; JSON output is the same in either.
TEXTS = {
    "indexed": ("indexed {indexed}, updated {updated}, unchanged {unchanged}, deleted {deleted}, failed {n_failed}", "добавлено {indexed}, обновлено {updated}, без изменений {unchanged}, удалено {deleted}, ошибок {n_failed}"),
    "removed": ("removed {n} files", "удалено файлов: {n}"),
    "fresh": ("the index is up to date", "индекс актуален"),
    "status": (
        "index {base}\nfiles {files}, chunks {chunks}, vectors {vectors}, {bytes} bytes in {segments} segments\nindexed at {indexed_at}, chunk size {chunk_size}, overlap {overlap}, chunker {chunker}",
        "индекс {base}\nфайлов {files}, фрагментов {chunks}, векторов {vectors}, {bytes} байт, сегментов {segments}\nобновлён {indexed_at}, размер фрагмента {chunk_size}, перекрытие {overlap}, разбиение {chunker}",
    ),
    "interrupted": ("interrupted: what was read is indexed, nothing was pruned", "прервано: прочитанное проиндексировано, удаление не выполнялось"),
    "nothing": ("nothing found", "ничего не найдено"),
}


def language(environ=os.environ) -> int:
    value = next((environ[k] for k in ("SIEVESTONE_LANG", "LC_ALL", "LC_MESSAGES", "LANG") if environ.get(k)), "en")
    return int(value.lower().startswith("ru"))


def say(key: str, **values) -> str:
    return TEXTS[key][language()].format(**values)


def _csv(text: str) -> list[str]:
    return [x.strip() for x in text.split(",") if x.strip()]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("sievestone")
    p.add_argument("--db")
    p.add_argument("--embed-url", default=os.environ.get("SIEVESTONE_EMBED_URL"))
    p.add_argument("--model", default="")
    p.add_argument("--query-prefix", default="")
    p.add_argument("--doc-prefix", default="")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("index")
    c.add_argument("path", nargs="?", default=".")
    for flag in ("--ext", "--exclude", "--include-hidden"):
        c.add_argument(flag, type=_csv, default=[])
    c.add_argument("--noisy-globs", type=_csv, default=list(NOISY))
    c.add_argument("--include-noisy", type=_csv, default=[])
    c.add_argument("--prune", action=argparse.BooleanOptionalAction, default=True)
    c.add_argument("--concurrency", type=int, default=4)
    for flag in ("--noisy", "--quiet", "--hidden", "--vendor", "--no-gitignore", "--embed", "--strict", "--json"):
        c.add_argument(flag, action="store_true")
    c.add_argument("--max-size", type=int, default=MAX_SIZE)
    c.add_argument("--chunk-size", type=int)
    c.add_argument("--overlap", type=int)
    c.add_argument("--chunker", choices=["auto", "text"])
    c = sub.add_parser("search")
    c.add_argument("query", nargs="+")
    c.add_argument("-k", type=int, default=10)
    c.add_argument("--mode", choices=["lexical", "semantic", "hybrid"], default="lexical")
    c.add_argument("--root")
    for flag in ("--ext", "--exclude", "--path"):
        c.add_argument(flag, type=_csv, default=[])
    c.add_argument("--dedupe", action="store_true")
    c.add_argument("--max-per-file", type=int, default=0)
    c.add_argument("--snippet", type=int, default=500)
    c.add_argument("--format", choices=["text", "json", "paths"], default="text")
    c = sub.add_parser("show")
    c.add_argument("ref")
    c.add_argument("--before", type=int, default=0)
    c.add_argument("--after", type=int, default=0)
    c.add_argument("--format", choices=["text", "json"], default="text")
    c = sub.add_parser("status")
    c.add_argument("--format", choices=["text", "json"], default="text")
    c = sub.add_parser("check")
    c.add_argument("path", nargs="?")
    c.add_argument("--hash", action="store_true")
    c.add_argument("--embed", action="store_true")
    c.add_argument("--list-limit", type=int, default=100)
    c = sub.add_parser("rm")
    c.add_argument("paths", nargs="+")
    sub.add_parser("version")
    return p


def run(args: argparse.Namespace) -> int:
    write = print
    if args.command == "version":
        write(f"sievestone {VERSION}")
        return 0
    base = find(os.getcwd(), args.db)
    if base is None:
        if args.command == "check":
            write(json.dumps({"issues": ["no_index"], "stale": True}))
            return 3
        if args.command != "index":
            raise IndexError_("no_index", "no index found")
        base = os.path.join(os.getcwd(), INDEX_DIR)
    e = Engine(local_session(), base, HttpEmbedder(args.embed_url, args.model) if args.embed_url else None, args.model, args.query_prefix, args.doc_prefix)
    if args.command == "index":
        if args.concurrency < 1:
            raise IndexError_("usage", "concurrency must be over 0")
        rules = Rules(args.ext, args.exclude, args.include_hidden, [] if args.noisy else args.noisy_globs, args.hidden, args.vendor, not args.no_gitignore, args.max_size, args.include_noisy)
        asked: list = []
        before = signal.signal(signal.SIGINT, lambda *_: asked.append(1)) if threading.current_thread() is threading.main_thread() else None
        try:
            report = e.index(args.path, rules, args.chunk_size, args.overlap, None if args.chunker is None else args.chunker == "auto", args.embed, args.strict, args.prune, args.concurrency, lambda: bool(asked))
        finally:
            if before is not None:
                signal.signal(signal.SIGINT, before)
        if args.json:
            write(json.dumps({"schema": ANSWER_SCHEMA} | report, ensure_ascii=False))
        elif not args.quiet:
            write(say("indexed", n_failed=len(report["failed"]), **{k: report[k] for k in ("indexed", "updated", "unchanged", "deleted")}))
            for path, code, message in report["failed"]:
                print(f"{code}: {path}: {message}", file=sys.stderr)
        if report["interrupted"]:
            print(say("interrupted"), file=sys.stderr)
            return 130
        return report["exit_code"]
    if args.command == "search":
        options = dict(k=args.k, mode=args.mode, root=args.root, exts=args.ext, exclude=args.exclude, include=args.path, dedupe=args.dedupe, max_per_file=args.max_per_file, snippet=args.snippet)
        if args.format == "json":
            write(e.search_json(" ".join(args.query), **options))
            return 0
        rows = e.search(" ".join(args.query), **options).collect()  # at most k
        if args.format == "paths":
            write("\n".join(dict.fromkeys(r.path for r in rows)))
        else:
            write("\n\n".join(f"{os.path.relpath(r.path)}#{r.seq}  {r.line_start}-{r.line_end}  {r.score:.3f}\n{r.text}" for r in rows) or say("nothing"))
        for path, code in e.stale(list(dict.fromkeys(r.path for r in rows))):
            print(f"{code}: {path}", file=sys.stderr)
    elif args.command == "show":
        if args.format == "json":
            write(e.show_json(args.ref, args.before, args.after))
            return 0
        write("\n".join(f"{r.path}#{r.seq}  {r.line_start}-{r.line_end}\n{r.text}" for r in e.show(args.ref, args.before, args.after).collect()))
        for path, code in e.stale([args.ref.rpartition("#")[0]]):
            print(f"{code}: {path}", file=sys.stderr)
    elif args.command == "status":
        status = e.status()
        write(json.dumps({"schema": ANSWER_SCHEMA} | status, ensure_ascii=False, default=str) if args.format == "json" else "\n".join([say("status", base=base, **({"indexed_at": "-"} | status)), *(f"{r}: {n}" for r, n in sorted(status["files_by_root"].items()))]))
    elif args.command == "check":
        report = e.check(args.path, args.hash, args.list_limit, args.embed)
        write(json.dumps(report, ensure_ascii=False) if report["stale"] else say("fresh"))
        return report["exit_code"]
    else:
        write(say("removed", n=e.rm(*args.paths)))
    return 0


def main(argv: list[str] | None = None) -> int:
    try:
        return run(parser().parse_args(argv))
    except (IndexError_, EmbedError) as e:
        print(json.dumps({"schema": ANSWER_SCHEMA, "error": {"code": e.code, "message": str(e)}}, ensure_ascii=False), file=sys.stderr)
        return 2 if e.code == "usage" else 1
    except KeyboardInterrupt:
        return 130


if __name__ == "__main__":
    sys.exit(main())
