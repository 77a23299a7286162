"""Command line: `python -m glyphloom ask TEXT` stems a text; `serve FOLDER OUT` answers the lines of files that come into a folder; `listen PORT` answers requests over TCP, and `send PORT TEXT` sends one."""

from __future__ import annotations

import argparse

from glyphloom.operators import morphology
from glyphloom.session import local_session
from glyphloom.streaming import gateway, service

TASKS = {"stem": morphology.stem_text, "identity": service.identity}


def main(arguments: list[str] | None = None) -> str | None:
    parser = argparse.ArgumentParser(prog="glyphloom", description=__doc__)
    parser.add_argument("--task", choices=TASKS, default="stem")
    parts = parser.add_subparsers(dest="what", required=True)
    parts.add_parser("ask").add_argument("text")
    serve = parts.add_parser("serve")
    serve.add_argument("folder")
    serve.add_argument("out")
    parts.add_parser("listen").add_argument("port", type=int)
    send = parts.add_parser("send")
    send.add_argument("port", type=int)
    send.add_argument("text")
    given = parser.parse_args(arguments)
    if given.what == "send":
        answer = gateway.ask_server(given.text, given.port)
        print(answer)
        return answer
    spark = local_session()
    if given.what == "ask":
        answer = service.ask(spark, given.text, TASKS[given.task])
        print(answer)
        return answer
    spark.streams.addListener(service.ServiceLog())
    if given.what == "listen":
        door = gateway.Gateway(port=given.port)
        print(f"answering on {door.host}:{door.port}", flush=True)
        gateway.serve(spark, door.address, TASKS[given.task]).awaitTermination()
        return None
    # A batch that comes again after a failure overwrites its own folder.
    write = lambda rows, n: rows.write.mode("overwrite").json(f"{given.out}/batch={n}")
    service.serve(service.file_requests(spark, given.folder), write, f"{given.out}/_checkpoint", TASKS[given.task]).awaitTermination()
    return None


if __name__ == "__main__":
    main()
