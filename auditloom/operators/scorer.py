"""Asks a model about pages: in batches, with retries, and each prompt once even where tasks are lost."""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame

from ..sources.scratch import scratch

#: Prompts asked at once, how often each is asked at most, and seconds before the second time; each further wait is twice as long.
BATCH, ATTEMPTS, WAIT = 5, 3, 1.0
REPLIES = "site string, page_id long, response string, error string, attempts int"


def ask(prompt: str, model: Callable[[str], str], attempts: int = ATTEMPTS, wait: float = WAIT) -> dict:
    """response, error and attempts of one prompt; whatever the model raises is tried again, and told if it stays."""
    for k in range(1, attempts + 1):
        try:
            return {"response": model(prompt) or "", "error": None, "attempts": k}
        except Exception as e:  # noqa: BLE001 - a model's failure is a row, not the end of the job
            error = f"{type(e).__name__}: {e}"
            if k < attempts:
                time.sleep(wait * 2 ** (k - 1))
    return {"response": None, "error": error, "attempts": attempts}


class _Kept:
    """Replies of a batch in a file of the shared folder, under the digest of its prompts."""

    def __init__(self, folder: str, prompts: list[str]) -> None:
        self.system, root = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        digest = hashlib.sha256("\0".join(prompts).encode()).hexdigest()
        self.path = f"{root}/{digest[:2]}/{digest}.json"

    def read(self) -> dict[str, dict]:
        if self.system.get_file_info(self.path).type == fs.FileType.NotFound:
            return {}
        with self.system.open_input_stream(self.path) as f:
            return json.loads(f.read())

    def write(self, found: dict[str, dict]) -> None:
        """Under another name first, so that no one reads half a file."""
        self.system.create_dir(self.path.rpartition("/")[0], recursive=True)
        new = f"{self.path}.{uuid.uuid4().hex}"
        with self.system.open_output_stream(new) as f:
            f.write(json.dumps(found).encode())
        self.system.move(new, self.path)


def ask_batch(prompts: list[str], model: Callable[[str], str], folder: str, attempts: int = ATTEMPTS, wait: float = WAIT) -> list[dict]:
    """Replies to a batch, together; those a former attempt of the task had are read, failures are asked again."""
    kept = _Kept(folder, prompts)
    found = kept.read()
    missing = [p for p in dict.fromkeys(prompts) if p not in found]
    if missing:
        with ThreadPoolExecutor(len(missing)) as pool:
            got = dict(zip(missing, pool.map(lambda p: ask(p, model, attempts, wait), missing), strict=True))
        found |= got
        kept.write({p: r for p, r in found.items() if r["error"] is None})
    return [found[p] for p in prompts]


def replies(prompts: DataFrame, model: Callable[[str], str], folder: str | None = None, batch: int = BATCH, attempts: int = ATTEMPTS, wait: float = WAIT) -> DataFrame:
    """REPLIES of every prompt (site, page_id, prompt); a prompt without a reply has an error. folder: keeps replies, also between jobs."""
    folder = folder or scratch(prompts.sparkSession, "replies")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, len(b), batch):
                part = b.slice(lo, batch)
                rows = ask_batch([p or "" for p in part.column("prompt").to_pylist()], model, folder, attempts, wait)
                told = [pa.array([r[c] for r in rows], t) for c, t in (("response", pa.string()), ("error", pa.string()), ("attempts", pa.int32()))]
                yield pa.RecordBatch.from_arrays([part.column("site"), part.column("page_id"), *told], names=[c.split()[0] for c in REPLIES.split(", ")])

    # the same batches in each attempt of a task: dealt by a key, in order
    return prompts.repartition("page_id").sortWithinPartitions("page_id", "site", "prompt").select("site", "page_id", "prompt").mapInArrow(run, REPLIES)


class Rehearsal:
    """Stands in for a model: answers from the prompt's length, fails once for one prompt in five and always for one in eleven."""

    def __init__(self) -> None:
        self.asked: set[str] = set()

    def __call__(self, prompt: str) -> str:
        n = len(prompt)
        if n % 11 == 0:
            raise ValueError("no answer")
        if n % 5 == 0 and prompt not in self.asked:
            self.asked.add(prompt)
            raise TimeoutError("slow")
        return f'{{"value": {n % 10}, "originality": {n % 7}, "relevance": {n % 9}, "compliance": 9, "translation": 8, "confidence": "high"}}'
