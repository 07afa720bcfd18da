"""Notes that come as files and in bundles."""

import json
import os
import tempfile

from tidelog.streaming import jobs


def test_files_and_bundles_give_each_note_once(spark):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    os.makedirs(f"{folder}/files/sub")
    os.makedirs(f"{folder}/bundles")
    for name, text in (("a.md", "one\n\ntwo"), ("sub/b.md", "three")):
        with open(f"{folder}/files/{name}", "w") as file:
            file.write(text)
    odd = {f"n{k}": text for k, text in enumerate(("a\r\nb", " \u0000\u0001\t\"\\", None, "", "\n# é\n" * 3000))}
    with open(f"{folder}/bundles/many.json", "w") as file:
        file.writelines(json.dumps({"uri": uri, "text": text}) + "\n" for uri, text in odd.items())
    seen = []

    def upsert(batch, batch_id):
        seen.extend((r.uri.rsplit("/", 1)[-1], r.text, r.modified is None) for r in batch.collect())

    for _ in range(2):
        jobs.watched_notes(spark, f"{folder}/files", upsert, f"{folder}/checkpoint", once=True, bundles=f"{folder}/bundles").awaitTermination()
    wanted = {"a.md": "one\n\ntwo", "b.md": "three", **odd}
    assert len(seen) == len(wanted) and set(seen) == {(uri, text, False) for uri, text in wanted.items()}
