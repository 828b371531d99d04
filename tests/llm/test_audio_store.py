"""Stored media and tensors."""

import hashlib

import numpy as np
import pyarrow as pa

from jointedge.llm import audio
from jointedge.llm.common import new_path


def test_audio_is_stored_and_read_back(spark):
    rows = [(1, "hello " * 5000), (2, None), (3, "x" * 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    folder = new_path(spark, "audio")
    index, seen = audio.stored(docs, folder).collect(), {}
    for r in index:
        clips, patches = audio.read_batch(folder, r.file, r.batch)
        assert patches.schema.field("mel").type == audio.TENSOR and clips.num_rows == r.rows
        for k, clip in enumerate(clips.to_pylist()):
            own = patches.filter(pa.compute.equal(patches["clip"], k))
            mel, spans = audio.analysed(audio.wav(audio.payload(dict(rows)[clip["doc_id"]])[1]))
            frames = own["mel"].to_numpy_ndarray().reshape(-1, audio.MELS)
            assert np.array_equal(frames[: clip["n_frames"]], mel) and clip["spans_s"] == [[audio.seconds(a), audio.seconds(b)] for a, b in spans]
            assert own["start_s"][0].as_py() == 0 and own["end_s"][-1].as_py() == audio.seconds(mel.shape[0])
            seen[clip["doc_id"]] = hashlib.sha256(clip["media"]).hexdigest()
    assert seen == {r.doc_id: r.media_sha256 for r in audio.digests(docs).collect()}
