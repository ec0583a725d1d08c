"""ELF files built byte by byte with ``struct``, apart from the SQL layouts."""

import struct

import pytest
from pyspark.sql import functions as F

from flowguard.operators import elf, elf_clean, scoring
from flowguard.operators.elf_columns import FEATURES, FILL, MODEL_INPUTS

NAMES = ["", ".text", ".init", ".debug_info", "xdata", ".shstrtab"]


def build(bits=64, little=True, segments=(), sections=None, machine=62, strtab=True):
    """segments: p_type values; sections: (name, type, size)."""
    order = "<" if little else ">"
    wide = bits == 64
    sections = [("", 0, 0), (".text", 1, 7)] if sections is None else list(sections)
    if strtab:
        sections.append((".shstrtab", 3, None))
    names, at = b"", {}
    for n, *_ in sections:
        at.setdefault(n, len(names))
        names += n.encode() + b"\0" if n not in at or at[n] == len(names) else b""
    hs, ps, ss = (64, 56, 64) if wide else (52, 32, 40)
    names_at = hs + ps * len(segments)
    sh_at = names_at + len(names)
    w = "Q" if wide else "I"
    head = b"\x7fELF" + bytes([2 if wide else 1, 1 if little else 2, 1, 3, 0]) + b"\0" * 7
    head += struct.pack(
        f"{order}HHI{w}{w}{w}IHHHHHH", 3, machine, 1, 0xFFFFFFFF80000000 if wide else 0x8000, hs if segments else 0,
        sh_at if sections else 0, 5, hs, ps, len(segments), ss, len(sections), len(sections) - 1 if strtab else 0,
    )
    ph = b""
    for i, kind in enumerate(segments):
        if wide:
            ph += struct.pack(order + "IIQQQQQQ", kind, 5 + i, 100 + i, 200 + i, 300 + i, 400 + i, 500 + i, 4096)
        else:
            ph += struct.pack(order + "IIIIIIII", kind, 100 + i, 200 + i, 300 + i, 400 + i, 500 + i, 5 + i, 4096)
    sh = b""
    for i, (n, kind, size) in enumerate(sections):
        size = len(names) if size is None else size
        place = names_at if n == ".shstrtab" else 1000 + i
        sh += struct.pack(f"{order}II{w}{w}{w}{w}II{w}{w}", at[n], kind, 6, 70 + i, place, size, 8, 9, 16, 24)
    return head + ph + names + sh


@pytest.fixture(scope="module")
def parse(spark):
    def run(**files):
        df = spark.createDataFrame(list(files.items()), "file_name string, content binary")
        return elf.parse(df)

    return run


def rows(parsed):
    return {r.file_name: r for r in elf.features(parsed, F.col("file_name"), F.lit("s")).collect()}


@pytest.mark.parametrize("bits", [32, 64])
@pytest.mark.parametrize("little", [True, False])
def test_fields(parse, bits, little):
    sections = [("", 0, 0), (".text", 1, 7), (".debug_info", 1, 11), ("xdata", 8, 13), (".text", 8, 99)]
    r = rows(parse(f=build(bits, little, [6, 1, 0x6474E551, 0x60000000], sections)))["f"]
    assert (r.num_sections, r.num_segments, r.machine_arch) == (6, 4, "x64")
    assert r.elf_head_ident_EI_CLASS == f"ELFCLASS{bits}"
    assert (r.dwarf_info_config_little_endian, r.dwarf_info_config_default_address_size) == (little, bits // 8)
    assert (r.elf_head_e_type, r.elf_head_e_machine, r.elf_head_ident_EI_OSABI) == ("ET_DYN", "EM_X86_64", "ELFOSABI_LINUX")
    assert r.elf_head_e_entry == (0xFFFFFFFF80000000 if bits == 64 else 0x8000)
    assert (r.seg0_head_p_type, r.seg1_head_p_type, r.seg2_head_p_type) == ("PT_PHDR", "PT_LOAD", "PT_GNU_STACK")
    assert r.seg0_PT_LOAD_p_offset is None
    assert (r.seg1_PT_LOAD_p_offset, r.seg1_PT_LOAD_p_vaddr, r.seg1_PT_LOAD_p_paddr) == (101, 201, 301)
    assert (r.seg1_PT_LOAD_p_filesz, r.seg1_PT_LOAD_p_memsz, r.seg1_PT_LOAD_p_flags) == (401, 501, 6)
    assert r.seg2_PT_GNU_STACK_p_align == 4096
    # of two sections with one name the last counts; a name loses its first character whatever it is
    assert (r.section_text, r.section_text_sh_size, r.section_text_sh_type) == (".text", 99, "SHT_NOBITS")
    assert (r.section_data, r.section_data_sh_size) == ("xdata", 13)
    assert (r.section__sh_type, r.section__sh_addralign, r.section_bss) == ("SHT_NULL", 16, None)
    assert (r.has_dwarf_info, r.dwarf_info_debug_info_sec_size, r.dwarf_info_debug_info_sec_address) == (True, 11, 72)
    assert (r.sec_header_sh_type, r.shstrndx, r.section_shstrtab_sh_entsize) == ("SHT_STRTAB", 5, 24)


def test_rejects_never_fail(parse):
    good = build(segments=[1])
    bad = {
        "text": b"hello", "empty": b"", "nothing": None, "magic": b"\x7fELF", "short": good[:40],
        "tables": good[:-1], "class": good[:4] + b"\x07" + good[5:], "names": build(sections=[], strtab=False),
        "good": good,
    }
    got = {r.file_name: r.error for r in parse(**bad).collect()}
    assert got == {
        "text": "not an ELF file", "empty": "not an ELF file", "nothing": "no content",
        "magic": "unknown class or byte order", "short": "truncated header", "tables": "truncated tables",
        "class": "unknown class or byte order", "names": "no section names", "good": None,
    }
    assert elf.rejects(parse(**bad)).count() == 8


def test_long_section_name(parse):
    name = ".text." + "x" * 700
    parsed = parse(f=build(sections=[("", 0, 0), (name, 1, 7), (".data", 1, 1)]))
    assert [s.name for s in parsed.first().sections] == ["", name, ".data", ".shstrtab"]


def test_dynamic_names(parse):
    parsed = parse(f=build(segments=[1, 0x60000000], sections=[("", 0, 0), (".text", 1, 7), (".text", 1, 8)]))
    got = {r.feature: r.value for r in elf.dynamic_features(parsed, "file_name").collect()}
    assert got["section_text_sh_size"] == "8" and got["section_"] == "" and got["section_text"] == ".text"
    assert got["seg1_head_p_type"] == "1610612736" and got["seg1_1610612736_p_memsz"] == "501"
    assert len(got) == 2 * 8 + 3 * 11


def test_clean(parse):
    parsed = parse(
        a=build(segments=[1]), b=build(machine=40, sections=[("", 0, 0), (".init", 1, 3), (".exidx", 0x70000001, 0)])
    )
    got = {r.file_name: r for r in elf_clean.clean(elf.features(parsed, F.col("file_name"), F.lit("s"))).collect()}
    a, b = got["a"], got["b"]
    assert (a.machine_arch, b.machine_arch) == (2, 1)  # ARM sorts before x64
    assert (a.elf_head_e_machine, b.elf_head_e_machine) == (2, 1)
    assert (a.seg0_head_p_type, b.seg0_head_p_type) == (1, None)
    assert (a.section_init, b.section_init, b.section_init_sh_type) == ("0", "1", "2")
    assert (a.section_text, b.section_text) == ("1", "0")
    assert (a.has_ehabi_info, b.has_ehabi_info, a.ehabi_infos, b.ehabi_infos) == (0, 1, 0, 1)
    assert (a.section_rodata_sh_entsize, a.section_init_sh_entsize, a.section_ctors_sh_link) == (2, 1, 0)
    assert (a.dwarf_info_debug_info_sec_name, a.dwarf_info_debug_info_sec_address) == ("0", 1)
    assert (a.sec_header_sh_type, a.section_shstrtab_sh_type, a.section__sh_type) == ("1", "1", "1")


def test_copies_are_folded(parse):
    same = build()
    parsed = parse(a=same, b=same).withColumn("file_name", F.lit("x"))
    assert elf_clean.clean(elf.features(parsed, F.col("file_name"), F.lit("s"))).count() == 1


def test_column_rules():
    assert (len(FEATURES), len(FILL), len(MODEL_INPUTS)) == (212, 173, 62)
    assert sorted(FILL.values()).count(1) == 41 and list(FILL.values()).count(2) == 1
    assert set(MODEL_INPUTS) <= set(FEATURES.names)


def test_conform(spark):
    df = spark.sql("SELECT map('file_size', '12', 'num_sections', 'many', 'odd', '1', 'section_text', '.text') AS f")
    row = elf_clean.conform(df, "f").first()
    assert (row.file_size, row.num_sections, row.section_text, len(row)) == (12, None, ".text", 212)


def test_verdicts_and_events(spark):
    files = spark.createDataFrame([("a", build()), ("b", build(segments=[1])), ("c", b"text")], "file_name string, content binary")
    verdict = elf_clean.verdicts(files, scoring.rule("num_segments = 1"), F.lit("s"))
    assert {r.file_name: r.prediction for r in verdict.collect()} == {"a": 0, "b": 1, "c": 0}
    transfers = spark.createDataFrame(
        [(k, "f", 0, k, 1, "s", "d", k != "open") for k in ("a", "b", "c", "open")],
        "key string, flow string, sess int, file_name string, size int, src_ip string, dst_ip string, closed boolean",
    )
    judged = {3: verdict.withColumnRenamed("file_name", "key"), 5: verdict.withColumnRenamed("file_name", "key")}
    got = elf_clean.file_events(transfers, judged, "key", force=(5,)).collect()
    assert sorted((r.type, r.detail.split('"file_name":"')[1][0]) for r in got) == [(3, "b"), (5, "a"), (5, "b"), (5, "c")]
    with pytest.raises(ValueError):
        elf_clean.file_events(transfers, {9: verdict}, "key")


def test_upper_codes_depend_on_the_machine(parse):
    sections = [("", 0, 0), ("xdata", 0x70000001, 4)]
    files = {str(m): build(machine=m, segments=[0x70000001], sections=sections) for m in (8, 40, 62, 183, 15)}
    parsed = parse(**files).collect()
    got = {r.file_name: (r.segments[0].p_type, r.sections[1].sh_type) for r in parsed}
    assert got == {
        "8": ("PT_MIPS_RTPROC", "SHT_MIPS_MSYM"), "40": ("PT_ARM_EXIDX", "SHT_ARM_EXIDX"), "62": ("1879048193", "SHT_AMD64_UNWIND"),
        "183": ("PT_AARCH64_UNWIND", "1879048193"), "15": ("1879048193", "1879048193"),
    }
    found = rows(parse(**files))
    assert {k: r.has_ehabi_info for k, r in found.items()} == {"8": False, "40": True, "62": False, "183": False, "15": False}
    assert found["15"].machine_arch == "Hewlett-Packard PA-RISC"


def test_extended_numbering(parse):
    plain = build(segments=[1, 2], sections=[("", 0, 0), (".text", 1, 7)])
    extended = bytearray(plain)
    table = struct.unpack_from("<Q", plain, 40)[0]
    struct.pack_into("<HH", extended, 60, 0, 0xFFFF)  # no number of sections, no index of the names
    struct.pack_into("<Q", extended, table + 32, 3)
    struct.pack_into("<I", extended, table + 40, 2)
    got = {r.file_name: r for r in parse(a=plain, b=bytes(extended)).collect()}
    assert got["b"].error is None
    assert [s.name for s in got["b"].sections] == [s.name for s in got["a"].sections] == ["", ".text", ".shstrtab"]
    struct.pack_into("<Q", extended, table + 32, 1 << 60)
    assert parse(c=bytes(extended)).first().error == "truncated tables"
