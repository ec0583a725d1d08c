"""ELF header features as Spark expressions.

Only four small slices of a file are looked at (header, program headers, section headers, section
names), all of them decoded inside the JVM; nothing is handed to Python workers.  The expressions
are written as SQL text: thousands of small ones are parsed faster than they are built call by call.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from flowguard.functions.once import once
from flowguard.operators.elf_columns import (
    DEBUG_SECTIONS, FEATURES, HEAD_FIELDS, IDENT_FIELDS, NAMED_SECTIONS, SECTION_FIELDS, SEGMENT_COLUMNS,
    SEGMENT_FIELDS, debug_columns, section_columns,
)

# The field layouts of the ELF specification as (name, bytes), for 32 and 64 bit.
HEADER = {
    32: [("e_type", 2), ("e_machine", 2), ("e_version", 4), ("e_entry", 4), ("e_phoff", 4), ("e_shoff", 4),
         ("e_flags", 4), ("e_ehsize", 2), ("e_phentsize", 2), ("e_phnum", 2), ("e_shentsize", 2),
         ("e_shnum", 2), ("e_shstrndx", 2)],
    64: [("e_type", 2), ("e_machine", 2), ("e_version", 4), ("e_entry", 8), ("e_phoff", 8), ("e_shoff", 8),
         ("e_flags", 4), ("e_ehsize", 2), ("e_phentsize", 2), ("e_phnum", 2), ("e_shentsize", 2),
         ("e_shnum", 2), ("e_shstrndx", 2)],
}
SEGMENT = {
    32: [("p_type", 4), ("p_offset", 4), ("p_vaddr", 4), ("p_paddr", 4), ("p_filesz", 4), ("p_memsz", 4),
         ("p_flags", 4), ("p_align", 4)],
    64: [("p_type", 4), ("p_flags", 4), ("p_offset", 8), ("p_vaddr", 8), ("p_paddr", 8), ("p_filesz", 8),
         ("p_memsz", 8), ("p_align", 8)],
}
SECTION = {
    32: [("sh_name", 4), ("sh_type", 4), ("sh_flags", 4), ("sh_addr", 4), ("sh_offset", 4), ("sh_size", 4),
         ("sh_link", 4), ("sh_info", 4), ("sh_addralign", 4), ("sh_entsize", 4)],
    64: [("sh_name", 4), ("sh_type", 4), ("sh_flags", 8), ("sh_addr", 8), ("sh_offset", 8), ("sh_size", 8),
         ("sh_link", 4), ("sh_info", 4), ("sh_addralign", 8), ("sh_entsize", 8)],
}
HEADER_FIELDS = [name for name, _ in HEADER[32]]

# Names of the specification's codes.  A code without a name is shown as a number.
CLASSES = {1: "ELFCLASS32", 2: "ELFCLASS64"}
BYTE_ORDERS = {1: "ELFDATA2LSB", 2: "ELFDATA2MSB"}
OSABI = {
    0: "ELFOSABI_SYSV", 1: "ELFOSABI_HPUX", 2: "ELFOSABI_NETBSD", 3: "ELFOSABI_LINUX", 4: "ELFOSABI_HURD",
    6: "ELFOSABI_SOLARIS", 7: "ELFOSABI_AIX", 8: "ELFOSABI_IRIX", 9: "ELFOSABI_FREEBSD",
    10: "ELFOSABI_TRU64", 11: "ELFOSABI_MODESTO", 12: "ELFOSABI_OPENBSD", 13: "ELFOSABI_OPENVMS",
    14: "ELFOSABI_NSK", 15: "ELFOSABI_AROS", 97: "ELFOSABI_ARM", 255: "ELFOSABI_STANDALONE",
}
FILE_TYPES = {0: "ET_NONE", 1: "ET_REL", 2: "ET_EXEC", 3: "ET_DYN", 4: "ET_CORE"}
MACHINES = {
    0: "EM_NONE", 1: "EM_M32", 2: "EM_SPARC", 3: "EM_386", 4: "EM_68K", 5: "EM_88K", 6: "EM_IAMCU", 7: "EM_860",
    8: "EM_MIPS", 9: "EM_S370", 10: "EM_MIPS_RS3_LE", 15: "EM_PARISC", 17: "EM_VPP500", 18: "EM_SPARC32PLUS",
    19: "EM_960", 20: "EM_PPC", 21: "EM_PPC64", 22: "EM_S390", 23: "EM_SPU", 36: "EM_V800", 37: "EM_FR20",
    38: "EM_RH32", 39: "EM_RCE", 40: "EM_ARM", 41: "EM_ALPHA", 42: "EM_SH", 43: "EM_SPARCV9", 44: "EM_TRICORE",
    45: "EM_ARC", 46: "EM_H8_300", 47: "EM_H8_300H", 48: "EM_H8S", 49: "EM_H8_500", 50: "EM_IA_64",
    51: "EM_MIPS_X", 52: "EM_COLDFIRE", 53: "EM_68HC12", 54: "EM_MMA", 55: "EM_PCP", 56: "EM_NCPU", 57: "EM_NDR1",
    58: "EM_STARCORE", 59: "EM_ME16", 60: "EM_ST100", 61: "EM_TINYJ", 62: "EM_X86_64", 63: "EM_PDSP",
    64: "EM_PDP10", 65: "EM_PDP11", 66: "EM_FX66", 67: "EM_ST9PLUS", 68: "EM_ST7", 69: "EM_68HC16",
    70: "EM_68HC11", 71: "EM_68HC08", 72: "EM_68HC05", 73: "EM_SVX", 74: "EM_ST19", 75: "EM_VAX", 76: "EM_CRIS",
    77: "EM_JAVELIN", 78: "EM_FIREPATH", 79: "EM_ZSP", 80: "EM_MMIX", 81: "EM_HUANY", 82: "EM_PRISM", 83: "EM_AVR",
    84: "EM_FR30", 85: "EM_D10V", 86: "EM_D30V", 87: "EM_V850", 88: "EM_M32R", 89: "EM_MN10300", 90: "EM_MN10200",
    91: "EM_PJ", 92: "EM_OPENRISC", 93: "EM_ARC_COMPACT", 94: "EM_XTENSA", 95: "EM_VIDEOCORE", 96: "EM_TMM_GPP",
    97: "EM_NS32K", 98: "EM_TPC", 99: "EM_SNP1K", 100: "EM_ST200", 105: "EM_MSP430", 106: "EM_BLACKFIN",
    113: "EM_ALTERA_NIOS2", 140: "EM_TI_C6000", 164: "EM_QDSP6", 183: "EM_AARCH64", 185: "EM_AVR32",
    188: "EM_TILEPRO", 189: "EM_MICROBLAZE", 190: "EM_CUDA", 191: "EM_TILEGX", 195: "EM_ARC_COMPACT2",
    224: "EM_AMDGPU", 243: "EM_RISCV", 247: "EM_BPF", 252: "EM_CSKY", 258: "EM_LOONGARCH",
}
ARCHITECTURES = {
    1: "AT&T WE 32100", 2: "SPARC", 3: "x86", 4: "Motorola 68000", 5: "Motorola 88000", 6: "Intel MCU",
    7: "Intel 80860", 8: "MIPS", 9: "IBM System/370", 10: "MIPS RS3000 Little-endian", 15: "Hewlett-Packard PA-RISC",
    17: "Fujitsu VPP500", 18: "Enhanced SPARC", 19: "Intel 80960", 20: "PowerPC", 21: "64-bit PowerPC",
    22: "IBM System/390", 23: "IBM SPU/SPC", 36: "NEC V800", 37: "Fujitsu FR20", 38: "TRW RH-32",
    39: "Motorola RCE", 40: "ARM", 41: "Digital Alpha", 42: "Hitachi SH", 43: "SPARC Version 9",
    44: "Siemens TriCore embedded processor", 45: "Argonaut RISC Core, Argonaut Technologies Inc.", 46: "Hitachi H8/300",
    47: "Hitachi H8/300H", 48: "Hitachi H8S", 49: "Hitachi H8/500", 50: "Intel IA-64", 51: "MIPS-X",
    52: "Motorola ColdFire", 62: "x64", 183: "AArch64", 243: "RISC-V", 258: "LoongArch",
}
SEGMENT_TYPES = {
    0: "PT_NULL", 1: "PT_LOAD", 2: "PT_DYNAMIC", 3: "PT_INTERP", 4: "PT_NOTE", 5: "PT_SHLIB", 6: "PT_PHDR",
    7: "PT_TLS", 0x6474E550: "PT_GNU_EH_FRAME", 0x6474E551: "PT_GNU_STACK", 0x6474E552: "PT_GNU_RELRO",
    0x6474E553: "PT_GNU_PROPERTY",
}
# The upper codes mean something else on each machine.
MACHINE_SEGMENT_TYPES = {
    8: {0x70000000: "PT_MIPS_REGINFO", 0x70000001: "PT_MIPS_RTPROC", 0x70000002: "PT_MIPS_OPTIONS", 0x70000003: "PT_MIPS_ABIFLAGS"},
    40: {0x70000000: "PT_ARM_ARCHEXT", 0x70000001: "PT_ARM_EXIDX"},
    183: {0x70000000: "PT_AARCH64_ARCHEXT", 0x70000001: "PT_AARCH64_UNWIND", 0x70000002: "PT_AARCH64_MEMTAG_MTE"},
    243: {0x70000003: "PT_RISCV_ATTRIBUTES"},
}
SECTION_TYPES = {
    0: "SHT_NULL", 1: "SHT_PROGBITS", 2: "SHT_SYMTAB", 3: "SHT_STRTAB", 4: "SHT_RELA", 5: "SHT_HASH",
    6: "SHT_DYNAMIC", 7: "SHT_NOTE", 8: "SHT_NOBITS", 9: "SHT_REL", 10: "SHT_SHLIB", 11: "SHT_DYNSYM",
    14: "SHT_INIT_ARRAY", 15: "SHT_FINI_ARRAY", 16: "SHT_PREINIT_ARRAY", 17: "SHT_GROUP",
    18: "SHT_SYMTAB_SHNDX", 0x6FFFFFF6: "SHT_GNU_HASH", 0x6FFFFFFD: "SHT_GNU_verdef",
    0x6FFFFFFE: "SHT_GNU_verneed", 0x6FFFFFFF: "SHT_GNU_versym",
}
MACHINE_SECTION_TYPES = {
    8: {
        0x70000000: "SHT_MIPS_LIBLIST", 0x70000001: "SHT_MIPS_MSYM", 0x70000002: "SHT_MIPS_CONFLICT",
        0x70000003: "SHT_MIPS_GPTAB", 0x70000004: "SHT_MIPS_UCODE", 0x70000005: "SHT_MIPS_DEBUG",
        0x70000006: "SHT_MIPS_REGINFO", 0x7000000B: "SHT_MIPS_IFACE", 0x7000000C: "SHT_MIPS_CONTENT",
        0x7000000D: "SHT_MIPS_OPTIONS", 0x7000001E: "SHT_MIPS_DWARF", 0x70000020: "SHT_MIPS_SYMBOL_LIB",
        0x70000021: "SHT_MIPS_EVENTS", 0x7000002A: "SHT_MIPS_ABIFLAGS",
    },
    40: {
        0x70000001: "SHT_ARM_EXIDX", 0x70000002: "SHT_ARM_PREEMPTMAP", 0x70000003: "SHT_ARM_ATTRIBUTES",
        0x70000004: "SHT_ARM_DEBUGOVERLAY", 0x70000005: "SHT_ARM_OVERLAYSECTION",
    },
    62: {0x70000001: "SHT_AMD64_UNWIND"},
    183: {0x70000003: "SHT_AARCH64_ATTRIBUTES"},
    243: {0x70000003: "SHT_RISCV_ATTRIBUTES"},
}
NUMBER = "decimal(20,0)"  # holds any unsigned 64-bit value
MAGIC = "7F454C46"


def named(code: str, names: dict) -> str:
    """SQL: the specification's name of a code, or the number as text."""
    pairs = ", ".join(f"{k}L, '{v}'" for k, v in names.items())
    return f"coalesce(try_element_at(map({pairs}), bigint({code})), string({code}))"


def named_on_machine(code: str, names: dict, by_machine: dict) -> str:
    """SQL: the name of a code whose upper range depends on the file's machine."""
    own = " ".join(f"WHEN {machine} THEN {named(code, more)}" for machine, more in by_machine.items())
    return f"if({code} < 1879048192, {named(code, names)}, CASE int(_head.e_machine) {own} ELSE string({code}) END)"


def uint(h: str, at: int, size: int) -> str:
    """SQL: unsigned number of ``size`` bytes at byte ``at`` of the hex text ``h``."""
    straight = f"substring({h}, {2 * at + 1}, {2 * size})"
    turned = ", ".join(f"substring({h}, {2 * (at + i) + 1}, 2)" for i in reversed(range(size)))
    return f"cast(conv(if(_little, concat({turned}), {straight}), 16, 10) AS {NUMBER})"


def record(h: str, layouts: dict, start: int = 0) -> str:
    """SQL: struct of all fields of the record at byte ``start`` of the hex text ``h``."""

    def read(bits: int) -> str:
        fields, at = {}, start
        for name, size in layouts[bits]:
            fields[name] = uint(h, at, size)
            at += size
        return "named_struct(" + ", ".join(f"'{n}', {fields[n]}" for n, _ in layouts[32]) + ")"

    return f"if(_is64, {read(64)}, {read(32)})"


def _size(layouts: dict) -> str:
    return f"if(_is64, {sum(n for _, n in layouts[64])}, {sum(n for _, n in layouts[32])})"


def _struct(fields: dict[str, str]) -> str:
    return "named_struct(" + ", ".join(f"'{name}', {value}" for name, value in fields.items()) + ")"


def _section_row(s: str) -> dict[str, str]:
    kind = named_on_machine(f"{s}.sh_type", SECTION_TYPES, MACHINE_SECTION_TYPES)
    return {f: kind if f == "sh_type" else f"{s}.{f}" for f in SECTION_FIELDS}


def parse(files: DataFrame, content: str = "content") -> DataFrame:
    """Decode the headers of each file.

    Replaces ``content`` by ``file_size``, ``error`` (null for a readable file), ``head``,
    ``segments``, ``sections`` and ``strtab``.  A file that cannot be read only gets an ``error``.
    """
    other = [c for c in files.columns if c != content]

    def byte(i: int) -> str:
        return f"substring(_h, {2 * i + 1}, 2)"

    # 1: the header, whose class and byte order say how to read everything else
    top = once(files, _h=f"hex(substring({content}, 1, 64))", file_size=f"bigint(length({content}))")
    top = once(top, _is64=f"{byte(4)} = '02'", _little=f"{byte(5)} = '01'")
    top = once(
        top,
        _e1=f"""CASE WHEN {content} IS NULL THEN 'no content'
            WHEN substring(_h, 1, 8) <> '{MAGIC}' THEN 'not an ELF file'
            WHEN {byte(4)} NOT IN ('01', '02') OR {byte(5)} NOT IN ('01', '02') THEN 'unknown class or byte order'
            WHEN file_size < 16 + {_size(HEADER)} THEN 'truncated header' END""",
    )
    top = once(top, _head=f"if(_e1 IS NULL, {record('_h', HEADER, 16)}, NULL)")

    # 2: the two tables; where their numbers are too large for the header, the first section has them
    first = f"hex(substring({content}, int(_head.e_shoff) + 1, {_size(SECTION)}))"
    has_first = f"_e1 IS NULL AND _head.e_shoff > 0 AND _head.e_shoff + {_size(SECTION)} <= file_size"
    top = once(top, _z=f"if({has_first}, {first}, NULL)")
    top = once(top, _zero=f"if(_z IS NULL, NULL, {record('_z', SECTION)})")
    top = once(
        top,
        _phnum="if(_head.e_phnum = 65535 AND _zero IS NOT NULL, _zero.sh_info, _head.e_phnum)",
        _shnum="if(_head.e_shnum = 0 AND _zero IS NOT NULL, _zero.sh_size, _head.e_shnum)",
        _shstr="if(_head.e_shstrndx = 65535 AND _zero IS NOT NULL, _zero.sh_link, _head.e_shstrndx)",
    )

    def fits(offset: str, stride: str, count: str, layouts: dict) -> str:
        end = f"_head.{offset} + _head.{stride} * {count}"
        return f"({count} = 0 OR ({end} <= file_size AND _head.{stride} >= {_size(layouts)}))"

    segments, sections = ("e_phoff", "e_phentsize", "_phnum"), ("e_shoff", "e_shentsize", "_shnum")
    checked = once(
        top,
        _e2=f"""CASE WHEN _e1 IS NOT NULL THEN _e1
            WHEN NOT ({fits(*segments, SEGMENT)} AND {fits(*sections, SECTION)}) THEN 'truncated tables'
            WHEN _shstr >= _shnum THEN 'no section names' END""",
    )

    def records(offset: str, stride: str, count: str, layouts: dict) -> str:
        """Each record is cut out of the file on its own, then decoded."""
        at = f"int(_head.{offset}) + i * int(_head.{stride}) + 1"
        cuts = f"transform(sequence(0, int({count}) - 1), i -> hex(substring({content}, {at}, {_size(layouts)})))"
        none = f"cast(array() AS array<{'struct<' + ','.join(f'{n}:{NUMBER}' for n, _ in layouts[32]) + '>'}>)"
        return f"""CASE WHEN _e2 IS NOT NULL THEN NULL WHEN {count} = 0 THEN {none}
            ELSE transform({cuts}, h -> {record("h", layouts)}) END"""

    tables = once(checked, _segments=records(*segments, SEGMENT), _sections=records(*sections, SECTION))

    # 3: the section names
    found = once(tables, _strtab="try_element_at(_sections, int(_shstr) + 1)")
    found = once(
        found,
        error="""CASE WHEN _e2 IS NOT NULL THEN _e2
            WHEN _strtab.sh_offset + _strtab.sh_size > file_size THEN 'truncated section names' END""",
    )
    named_tables = once(
        found,
        _names=f"if(error IS NULL, substring({content}, int(_strtab.sh_offset) + 1, int(_strtab.sh_size)), NULL)",
    )

    # Up to the next zero byte, which is looked for nearby before the whole rest is decoded.
    at = "int(least(s.sh_name, _strtab.sh_size)) + 1"
    near = f"decode(substring(_names, {at}, 256), 'ISO-8859-1')"
    rest = f"decode(substring(_names, {at}, int(_strtab.sh_size)), 'ISO-8859-1')"
    name = f"substring_index(if(contains({near}, chr(0)), {near}, {rest}), chr(0), 1)"
    segment_row = _struct(
        {"p_type": named_on_machine("s.p_type", SEGMENT_TYPES, MACHINE_SEGMENT_TYPES), **{f: f"s.{f}" for f in SEGMENT_FIELDS}}
    )
    arch = ", ".join(f"{k}L, '{v}'" for k, v in ARCHITECTURES.items())
    head = {
        "EI_CLASS": named(f"conv({byte(4)}, 16, 10)", CLASSES),
        "EI_DATA": named(f"conv({byte(5)}, 16, 10)", BYTE_ORDERS),
        "EI_OSABI": named(f"conv({byte(7)}, 16, 10)", OSABI),
        "EI_ABIVERSION": f"int(conv({byte(8)}, 16, 10))",
        "e_type": named("_head.e_type", FILE_TYPES),
        "e_machine": named("_head.e_machine", MACHINES),
        "arch": f"coalesce(try_element_at(map({arch}), bigint(_head.e_machine)), '<unknown>')",
        **{f: f"_head.{f}" for f in HEADER_FIELDS if f not in ("e_type", "e_machine")},
    }
    return once(
        named_tables,
        head=f"if(error IS NULL, {_struct(head)}, NULL)",
        segments=f"if(error IS NULL, transform(_segments, s -> {segment_row}), NULL)",
        sections=f"if(error IS NULL, transform(_sections, s -> {_struct({'name': name, **_section_row('s')})}), NULL)",
        strtab=f"if(error IS NULL, {_struct(_section_row('_strtab'))}, NULL)",
    ).select(*other, "file_size", "error", "head", "segments", "sections", "strtab")


def section(key: str) -> str:
    """SQL: the last section whose name without its first character is ``key``."""
    return f"try_element_at(filter(sections, s -> substring(s.name, 2) = '{key}'), -1)"


def named_section(name: str) -> str:
    """SQL: the last section of that name."""
    return f"try_element_at(filter(sections, s -> s.name = '{name}'), -1)"


def rejects(parsed: DataFrame) -> DataFrame:
    """Files that could not be read, with the reason."""
    return parsed.where("error IS NOT NULL").drop("head", "segments", "sections", "strtab")


def dynamic_features(parsed: DataFrame, key: str) -> DataFrame:
    """Long form (``key``, ``feature``, ``value``) of everything known about segments and sections.

    Names follow the file: ``seg{i}_{type}_p_*`` and ``section_{name}_sh_*``; of sections with the
    same name the last one counts.
    """
    def entry(name: Column, value: Column, place: Column) -> Column:
        return F.struct(name.alias("feature"), value.cast("string").alias("value"), place.alias("place"))

    def of_segment(s: Column, i: Column) -> Column:
        seg = F.concat(F.lit("seg"), i.cast("string"), F.lit("_"))
        return F.array(
            entry(F.concat(seg, F.lit("head_p_type")), s["p_type"], i),
            *[entry(F.concat(seg, s["p_type"], F.lit(f"_{f}")), s[f], i) for f in SEGMENT_FIELDS],
        )

    def of_section(s: Column, i: Column) -> Column:
        base = F.concat(F.lit("section_"), F.substr(s["name"], F.lit(2)))
        return F.array(
            entry(base, s["name"], i),
            *[entry(F.concat(base, F.lit(f"_{f}")), s[f], i) for f in SECTION_FIELDS],
        )

    entries = F.concat(
        F.flatten(F.transform("segments", of_segment)), F.flatten(F.transform("sections", of_section))
    )
    return (
        parsed.where("error IS NULL")
        .select(key, F.inline(entries))
        .groupBy(key, "feature")
        .agg(F.max_by("value", "place").alias("value"))
    )


def features(parsed: DataFrame, name: Column, scan: Column) -> DataFrame:
    """The fixed feature row of each readable file, without a detour over dynamic names.

    ``scan`` labels the set of files that is looked at together.
    """
    found = {f"_d_{d}": named_section(f".debug_{d}") for d in DEBUG_SECTIONS}
    found |= {f"_s_{s}": section(s) for s in ["", *NAMED_SECTIONS]}
    found |= {f"_seg{i}": f"try_element_at(segments, {i + 1})" for i in range(3)}

    def has(*names: str) -> str:
        return f"exists(sections, s -> s.name IN ({', '.join(repr(n) for n in names)}))"

    exidx = "exists(sections, s -> s.sh_type = 'SHT_ARM_EXIDX')"
    readable = parsed.where("error IS NULL").withColumns({"_name": name, "_scan": scan})
    ready = once(readable, _exidx=exidx, **found)
    out = {
        "file_name": "_name",
        "label": "_scan",
        "file_size": "file_size",
        "num_sections": "size(sections)",
        "num_segments": "size(segments)",
        "has_dwarf_info": has(".debug_info", ".zdebug_info", ".eh_frame"),
        "dwarf_info_config_machine_arch": "head.arch",
        "dwarf_info_config_default_address_size": "if(head.EI_CLASS = 'ELFCLASS64', 8, 4)",
        "dwarf_info_config_little_endian": "head.EI_DATA = 'ELFDATA2LSB'",
        "has_ehabi_info": "_exidx",
        "ehabi_infos": "if(_exidx, 1, NULL)",
        "machine_arch": "head.arch",
        "shstrndx": "head.e_shstrndx",
    }
    for d in DEBUG_SECTIONS:
        of_section = ("name", "sh_offset", "sh_size", "sh_addr")
        out |= {c: f"_d_{d}.{f}" for c, f in zip(debug_columns(d), of_section, strict=True)}
    out |= {f"sec_header_{f}": f"strtab.{f}" for f in SECTION_FIELDS}
    out |= {f"elf_head_ident_{f}": f"head.{f}" for f in IDENT_FIELDS}
    out |= {f"elf_head_{f}": f"head.{f}" for f in HEAD_FIELDS}
    for i, kind in enumerate(SEGMENT_COLUMNS):
        out[f"seg{i}_head_p_type"] = f"_seg{i}.p_type"
        out |= {f"seg{i}_{kind}_{f}": f"if(_seg{i}.p_type = '{kind}', _seg{i}.{f}, NULL)" for f in SEGMENT_FIELDS}
    for s in ["", *NAMED_SECTIONS]:
        if s:
            out[f"section_{s}"] = f"_s_{s}.name"
        out |= {c: f"_s_{s}.{f}" for c, f in zip(section_columns(s), SECTION_FIELDS, strict=True)}
    return ready.selectExpr(
        *[f"cast({out[f.name]} AS {f.dataType.simpleString()}) AS {f.name}" for f in FEATURES]
    )
