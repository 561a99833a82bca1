"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import fingerprints, idfiles, media, mixing, neardup, packing, privacy, quality, sharding, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_nbsvm_quality": quality.op1_nbsvm_quality,
    "op2_bbit_minhash": neardup.op2_bbit_minhash,
    "op3_huffman_ids": idfiles.op3_huffman_ids,
    "op4_lz_phrases": fingerprints.op4_lz_phrases,
    "op5_soft_mixing": mixing.op5_soft_mixing,
    "op6_disclosure": privacy.op6_disclosure,
    "op7_two_pass_shuffle": sharding.op7_two_pass_shuffle,
    "op8_wav_peaks": media.op8_wav_peaks,
    "op9_minimum_bin_slack": packing.op9_minimum_bin_slack,
    "op10_nearest_toxic": toxicity.op10_nearest_toxic,
}

#: The others: fitted models (1, 5, 6, 10), the library's tokenizer (3, 9), phrase and spectral hashes (4, 8) and a
#: seeded shuffle (7) are not to be said in SQL; tests/llm has brute-force versions, exact round trips and held-out accuracy.
SQL: dict[str, str] = {
    "op2_bbit_minhash": neardup.SQL,
}
