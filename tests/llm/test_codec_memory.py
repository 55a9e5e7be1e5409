"""Workers hold one vocabulary per model, and none once another operator's task runs in them."""
import public_tokenizers
import pyarrow as pa
import tokenizers

from stratum.llm import pieces
from stratum.llm import sentencepiece_backend as S

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def test_tokenizers_go_when_another_operator_runs():
    first = S.codec(MODEL).run(pa.array(["some text", "  two  spaces", ""]))
    assert S._CODECS
    list(pieces.without_pieces(lambda batches: iter(()))(iter(())))
    assert not S._CODECS and not any(t.encode.__self__.__class__ is S.Codec for t in pieces.Known.tables
                                     if hasattr(t.encode, "__self__"))
    assert S.codec(MODEL).run(pa.array(["some text", "  two  spaces", ""])) == first


def test_encoder_keeps_its_own_tokenizer():
    work = S.codec(MODEL)
    pieces.Known.release(but=work.known)
    assert S.codec(MODEL) is work


def test_one_vocabulary_per_model(monkeypatch):
    made = []
    real = tokenizers.models.BPE
    monkeypatch.setattr(tokenizers.models, "BPE", lambda *a, **b: made.append(1) or real(*a, **b))
    S.Codec(MODEL)
    pieces.Known.tables.pop()
    assert len(made) == 1
