"""Induced sorting against plain sorting, with all that grows on disk."""

import subprocess
import sys
import time

import numpy as np

from weftline.llm.induced_sort import suffix_array


def brute(t, cap):
    s = [bytes(t[i:]) for i in range(len(t))]
    order = sorted(range(len(t)), key=lambda i: s[i])
    lcp = [0]
    for a, b in zip(order, order[1:]):
        k = 0
        while k < cap and max(a, b) + k < len(t) and t[a + k] == t[b + k]:
            k += 1
        lcp.append(k)
    return order, lcp


def test_equals_plain_sorting(tmp_path):
    rng = np.random.default_rng(8)
    for n in range(400):
        letters = int(rng.integers(1, 5)) if n % 2 else 30
        t = rng.integers(1, letters + 1, int(rng.integers(0, 120))).astype(np.uint8)
        if n % 3 == 0 and len(t):
            t = np.tile(t[: int(rng.integers(1, 12))], 12)
        t = np.append(t, 0).astype(np.uint8)
        cap = int(rng.integers(1, 60))
        order, lcp = brute(t, cap)
        array, got = suffix_array(t, cap, memory=200 if n % 2 else 1 << 20, folder=str(tmp_path), short=0 if n % 5 else 1 << 20)
        assert array.tolist() == order
        assert got.tolist() == lcp
    assert not list(tmp_path.iterdir())


def test_larger_text():
    rng = np.random.default_rng(9)
    words = [bytes(rng.integers(97, 123, int(rng.integers(2, 8))).astype(np.uint8)) for _ in range(500)]
    text = b" ".join(words[i] for i in rng.integers(0, 500, 40000))
    t = np.append(np.frombuffer(text + text[5000:9000], np.uint8), 0).astype(np.uint8)
    began = time.time()
    array, lcp = suffix_array(t, 100, short=5000)
    assert suffix_array(t, 100)[0].tolist() == array.tolist()
    print(len(t), time.time() - began)
    raw = t.tobytes()
    for i in rng.integers(1, len(t), 3000).tolist():
        a, b = int(array[i - 1]), int(array[i])
        assert raw[a : a + 300] <= raw[b : b + 300]
        k = 0
        while k < 100 and raw[a + k : a + k + 1] == raw[b + k : b + k + 1]:
            k += 1
        assert k == lcp[i]
    assert len(set(array.tolist())) == len(t)


RESIDENT = """
import sys
import numpy as np
from weftline.llm.induced_sort import scratch, sorted_suffixes

own = lambda: next(int(l.split()[1]) for l in open("/proc/self/status") if l.startswith("RssAnon")) / 1024
n, memory = int(sys.argv[1]), 1 << 18
rng = np.random.default_rng(3)
passage = rng.integers(97, 123, 400).astype(np.uint8)
folder, space = scratch(memory)
with folder:
    t = space.text(n + 1, np.uint8)
    for lo in range(0, n, 2000):  # a passage beside ever different text
        part = np.concatenate([passage, rng.integers(97, 123, 1600).astype(np.uint8)])[: min(2000, n - lo)]
        t[lo : lo + len(part)] = part
    import threading
    peak, done = [own()], threading.Event()
    def watch():
        while not done.wait(0.02):
            peak[0] = max(peak[0], own())
    before = own()
    thread = threading.Thread(target=watch)
    thread.start()
    array, lcp = sorted_suffixes(t, 100, space)
    done.set()
    thread.join()
    raw = t.tobytes()
    for i in rng.integers(1, n, 500).tolist():
        a, b = int(array[i - 1]), int(array[i])
        assert raw[a : a + 300] <= raw[b : b + 300]
    assert int(array.astype(np.int64).sum()) == n * (n + 1) // 2
print(peak[0] - before)
"""


def test_memory_does_not_follow_the_text():
    """A text of 10 times the memory and one of 20 times sort in the same resident memory, a fraction of the text's arrays."""
    root = __file__.split("/tests/")[0]
    took = [float(subprocess.run([sys.executable, "-c", RESIDENT, str(n << 18)], cwd=root, capture_output=True, text=True, check=True).stdout) for n in (10, 20)]
    print("resident MB", took)
    assert max(took) < 16 and took[1] < took[0] + 5
