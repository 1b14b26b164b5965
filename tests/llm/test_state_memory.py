"""What a state of op2's transducer takes in memory, and that its tables stay right when they are emptied on the way."""

import base64
import random
import tracemalloc


def test_states_are_small():
    import public_tokenizers as public
    import tiktoken

    from tessellum.llm.byte_bpe import ByteBpe

    path = public.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    e = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(2)
    words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyzéß日") for _ in range(r.randint(4, 14))) for _ in range(4000)]
    t = ByteBpe(path, public.PATTERN).known.transducer
    tracemalloc.start()
    got = [t.encode(w.encode()) for w in words]
    size, states = tracemalloc.get_traced_memory()[0] - sum(map(len, got)) * 8, len(t.states)
    tracemalloc.stop()
    assert got == [tuple(e.encode_ordinary(w)) for w in words]
    assert states > 10_000 and size / states < 780, size / states
    t.keep_states = 500
    assert [t.encode(w.encode()) for w in words[:500]] == got[:500] and len(t.states) < 2000
