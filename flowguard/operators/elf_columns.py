"""Columns of the ELF feature table and the rules that clean them."""

from __future__ import annotations

from pyspark.sql import types as T

# Sections, segments and fields the feature table has columns for.
NAMED_SECTIONS = ["init", "text", "fini", "rodata", "ctors", "dtors", "data", "bss", "shstrtab"]
SEGMENT_COLUMNS = ["PT_LOAD", "PT_LOAD", "PT_GNU_STACK"]  # kind kept for segment 0, 1 and 2
SEGMENT_FIELDS = ["p_offset", "p_filesz", "p_memsz", "p_flags", "p_align", "p_vaddr", "p_paddr"]
SECTION_FIELDS = [
    "sh_name", "sh_type", "sh_flags", "sh_addr", "sh_offset", "sh_size", "sh_link", "sh_info",
    "sh_addralign", "sh_entsize",
]
DEBUG_SECTIONS = [
    "info", "aranges", "abbrev", "frame", "str", "loc", "ranges", "line", "pubtypes", "pubnames",
]
IDENT_FIELDS = ["EI_CLASS", "EI_DATA", "EI_OSABI", "EI_ABIVERSION"]
HEAD_FIELDS = [
    "e_type", "e_machine", "e_entry", "e_phoff", "e_shoff", "e_flags", "e_ehsize", "e_phentsize",
    "e_phnum", "e_shentsize", "e_shnum", "e_shstrndx",
]

NUMBER = T.DecimalType(20, 0)  # holds any unsigned 64-bit value


def section_columns(section: str) -> list[str]:
    return [f"section_{section}_{f}" for f in SECTION_FIELDS]


def debug_columns(section: str) -> list[str]:
    return [f"dwarf_info_debug_{section}_sec_{f}" for f in ("name", "global_offset", "size", "address")]


def _columns() -> list[str]:
    names = ["file_name", "label", "file_size", "num_sections", "num_segments", "has_dwarf_info"]
    names += [f"dwarf_info_config_{x}" for x in ("machine_arch", "default_address_size", "little_endian")]
    for s in DEBUG_SECTIONS:
        names += debug_columns(s)
    names += ["has_ehabi_info", "ehabi_infos", "machine_arch", "shstrndx"]
    names += [f"sec_header_{f}" for f in SECTION_FIELDS]
    names += [f"elf_head_ident_{f}" for f in IDENT_FIELDS] + [f"elf_head_{f}" for f in HEAD_FIELDS]
    for i, kind in enumerate(SEGMENT_COLUMNS):
        names += [f"seg{i}_head_p_type"] + [f"seg{i}_{kind}_{f}" for f in SEGMENT_FIELDS]
    names += section_columns("")
    for s in NAMED_SECTIONS:
        names += [f"section_{s}"] + section_columns(s)
    return names


# Columns coded by their rank among the scan's values.
CODED = [
    "dwarf_info_config_machine_arch", "machine_arch", "elf_head_ident_EI_CLASS",
    "elf_head_ident_EI_DATA", "elf_head_ident_EI_OSABI", "elf_head_e_type", "elf_head_e_machine",
    "seg0_head_p_type",
]
FLAGS = ["has_dwarf_info", "dwarf_info_config_little_endian", "has_ehabi_info"]
TEXTS = (
    ["file_name", "label", *CODED, "seg1_head_p_type", "seg2_head_p_type", "sec_header_sh_type"]
    + ["section__sh_type"]
    + [f"section_{s}{x}" for s in NAMED_SECTIONS for x in ("", "_sh_type")]
    + [f"dwarf_info_debug_{s}_sec_name" for s in DEBUG_SECTIONS]
)


def _type(name: str) -> T.DataType:
    if name in TEXTS:
        return T.StringType()
    return T.BooleanType() if name in FLAGS else NUMBER


FEATURES = T.StructType([T.StructField(n, _type(n)) for n in _columns()])

# What replaces a missing value.  Identity, header and string-table columns are never
# filled; all others get 0 except these.
NEVER_FILLED = (
    ["file_name", "label", "file_size", "num_sections", "num_segments", "has_dwarf_info"]
    + ["dwarf_info_config_machine_arch", "dwarf_info_config_default_address_size"]
    + ["dwarf_info_config_little_endian", "has_ehabi_info", "machine_arch", "shstrndx"]
    + [f"sec_header_{f}" for f in SECTION_FIELDS]
    + [f"elf_head_ident_{f}" for f in IDENT_FIELDS]
    + [f"elf_head_{f}" for f in HEAD_FIELDS]
    + ["seg0_head_p_type"]
)
FILLED_WITH_ONE = (
    [f"dwarf_info_debug_{s}_sec_address" for s in DEBUG_SECTIONS]
    + [c for c in section_columns("") if c != "section__sh_type"]
    + ["section_init"]
    + [f"section_{s}_{f}" for s in ("init", "text", "data", "bss") for f in ("sh_link", "sh_info", "sh_entsize")]
    + [f"section_{s}_{f}" for s in ("fini", "rodata") for f in ("sh_link", "sh_info")]
    + [f"section_shstrtab_{f}" for f in ("sh_flags", "sh_addr", "sh_link", "sh_info", "sh_entsize")]
)
FILLED_WITH_TWO = ["section_rodata_sh_entsize"]


def _fill(name: str) -> int:
    return 1 if name in FILLED_WITH_ONE else 2 if name in FILLED_WITH_TWO else 0


FILL = {f.name: _fill(f.name) for f in FEATURES if f.name not in NEVER_FILLED}

# Replacements of names by numbers.
_CODE = {"SHT_NOBITS": 1, "SHT_PROGBITS": 2}
VALUE_MAPS: dict[str, dict] = {
    "sec_header_sh_type": {"SHT_NULL": 0, "SHT_STRTAB": 1},
    **{f"dwarf_info_debug_{s}_sec_name": {f".debug_{s}": 1} for s in DEBUG_SECTIONS if s != "pubtypes"},
    "seg1_head_p_type": {"PT_INTERP": 1, "PT_LOAD": 2, "PT_NOTE": 3, "PT_PHDR": 4},
    "seg2_head_p_type": {
        "PT_DYNAMIC": 1, "PT_GNU_STACK": 2, "PT_INTERP": 3, "PT_LOAD": 4, "PT_NOTE": 5, "PT_TLS": 6,
    },
    "section__sh_type": {"SHT_NULL": 1},
    "section_init": {1: 0, ".init": 1},
    **{f"section_{s}": {f".{s}": 1} for s in ("text", "fini", "rodata", "data", "bss", "shstrtab")},
    **{f"section_{s}_sh_type": _CODE for s in ("init", "text", "fini", "rodata", "data")},
    "section_bss_sh_type": {"SHT_NOBITS": 1},
    "section_shstrtab_sh_type": {"SHT_STRTAB": 1},
}

# The 62 inputs of the file models, in order.
MODEL_INPUTS = [
    "elf_head_e_type", "elf_head_ident_EI_OSABI", "dwarf_info_config_machine_arch", "machine_arch",
    "dwarf_info_config_default_address_size", "elf_head_e_phentsize", "elf_head_ident_EI_CLASS",
    "seg0_head_p_type", "has_dwarf_info", "elf_head_e_phnum", "seg1_PT_LOAD_p_flags",
    "section_ctors_sh_flags", "section_text_sh_name", "section_rodata_sh_name", "elf_head_e_ehsize",
    "num_segments", "section_dtors_sh_flags", "section_data_sh_name", "section_fini_sh_name",
    "elf_head_e_shentsize", "section_ctors_sh_name", "seg2_PT_GNU_STACK_p_flags",
    "section_init_sh_name", "section_dtors_sh_name", "section_ctors_sh_addralign",
    "section_dtors_sh_addralign", "section_bss_sh_name", "section_bss_sh_size",
    "elf_head_e_machine", "section_shstrtab_sh_name", "shstrndx", "elf_head_e_shstrndx",
    "seg2_PT_GNU_STACK_p_align", "elf_head_e_shnum", "seg0_PT_LOAD_p_filesz",
    "section_shstrtab_sh_size", "num_sections", "elf_head_e_entry", "seg0_PT_LOAD_p_memsz",
    "sec_header_sh_size", "seg1_PT_LOAD_p_memsz", "file_size", "seg0_PT_LOAD_p_flags",
    "seg1_PT_LOAD_p_vaddr", "section_rodata_sh_offset", "sec_header_sh_name", "elf_head_e_shoff",
    "section_data_sh_addralign", "section_rodata_sh_addr", "section_rodata_sh_size",
    "seg1_PT_LOAD_p_paddr", "section_fini_sh_offset", "section_bss_sh_offset",
    "section_ctors_sh_addr", "section_text_sh_size", "sec_header_sh_offset",
    "section_ctors_sh_offset", "section_data_sh_size", "section_data_sh_offset",
    "seg1_PT_LOAD_p_offset", "section_init_sh_addralign", "section_dtors_sh_addr",
]
