import subprocess
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

#: The pipeline's Python steps over 32 MB of text in one task after another, then the memory of the idle workers, in MB.
IDLE = """
import re, sys
from pathlib import Path
import psutil, public_tokenizers
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
from tidemark.llm import bpe, suffix_dedup
spark = SparkSession.builder.master("local[1]").config("spark.sql.shuffle.partitions", "1").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", sys.argv[3]).config("spark.sql.warehouse.dir", sys.argv[3]).getOrCreate()
docs = spark.read.parquet(sys.argv[2])
def idle():
    workers = [p.pid for p in psutil.Process().children(recursive=True) if "pyspark" in " ".join(p.cmdline()) and p.name().startswith("python")]
    return max(int(re.search(r"RssAnon:\\s+(\\d+)", Path(f"/proc/{pid}/status").read_text())[1]) >> 10 for pid in workers)
suffix_dedup.remove_repeats(docs).write.parquet(f"{sys.argv[3]}/left")
one = idle()
bpe.digest_documents(docs, public_tokenizers.path("byte_bpe_50k.json")).write.parquet(f"{sys.argv[3]}/ids")
print(one, idle())
"""


def test_idle_workers_have_given_memory_back(tmp_path):
    """They count towards the executor's limit while the other stages run."""
    rng = np.random.default_rng(1)
    words = np.array(["".join(rng.choice(list("abcdefghé"), rng.integers(2, 9))) for _ in range(50_000)], object)
    texts = [" ".join(rng.choice(words, 400)) for _ in range(16_000)]
    pq.write_table(pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts}), tmp_path / "documents.parquet")
    done = subprocess.run([sys.executable, "-c", IDLE, str(Path(__file__).resolve().parents[2]), str(tmp_path / "documents.parquet"), str(tmp_path / "shared")], capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-2000:]
    cut, tokens = map(int, done.stdout.split()[-2:])
    assert cut < 120 and tokens < 180, (cut, tokens)
