"""What a worker holds after packing."""

import pyarrow as pa

from quarry.llm import packing


def test_units_are_let_go_with_the_task():
    """A worker that Spark keeps for other work doesn't keep the units that packing has encoded."""
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["some words of a text", None])], names=["doc_id", "text"])
    made = [r for b in packing._piece_rows("byte_bpe_50k.json", 2048, 0)(iter([batch])) for r in b.to_pylist()]
    assert [(r["doc_id"], r["piece"], r["start"]) for r in made] == [(1, 0, 0), (2, 0, 0)] and made[1]["length"] == 1
    assert not packing._encoder("byte_bpe_50k.json").known
