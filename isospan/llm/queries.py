"""Registered queries of the pipeline operators: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from .common import read_table


def op1_fingerprints(spark, sf_dir):
    from .fingerprints import fingerprint_edits

    return fingerprint_edits(read_table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark, sf_dir):
    from .suffix_dedup import remove_repeats

    return remove_repeats(read_table(spark, sf_dir, "documents"))


def op3_mixing(spark, sf_dir):
    from .mixing import mix

    return mix(read_table(spark, sf_dir, "documents"))


def op4_pii(spark, sf_dir):
    from .pii import find_personal_data

    return find_personal_data(read_table(spark, sf_dir, "documents")).drop("entities")


def pii_base_kinds(spark, sf_dir):
    return op4_pii(spark, sf_dir).drop("spans", "n_spans", "scores")


def op5_packing(spark, sf_dir):
    from .packing import pack

    return pack(read_table(spark, sf_dir, "documents"))


def op6_langid(spark, sf_dir):
    from .langid import identify

    return identify(read_table(spark, sf_dir, "documents"))


def op7_top_k(spark, sf_dir):
    from .covertree import top_k

    rows = read_table(spark, sf_dir, "embeddings")
    return top_k(rows, rows.where("vec_id % 50 = 0"))


def op8_line_dedup(spark, sf_dir):
    from .linedup import remove_repeated_lines

    return remove_repeated_lines(read_table(spark, sf_dir, "documents"))


def op9_simhash(spark, sf_dir):
    from .simhash import near_duplicates

    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op10_warc(spark, sf_dir):
    from .warc import archive_pages

    return archive_pages(read_table(spark, sf_dir, "pages"))


def op11_whitening(spark, sf_dir):
    from .whitening import whiten

    return whiten(read_table(spark, sf_dir, "embeddings"))


def op12_token_files(spark, sf_dir):
    from .huffman import token_digests

    return token_digests(read_table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark, sf_dir):
    from .conversations import audit_conversations

    return audit_conversations(read_table(spark, sf_dir, "conversations"), damage=True)


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith(("op", "pii_")) and callable(f)}
