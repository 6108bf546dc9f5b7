"""Files of any known format to one table of paragraphs: the dispatch by suffix, in one pass over the files.

A file that can't be read is one row with an error, never an exception on an executor.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from docblocks.readers import docx, html, markdown, odt, pdf
from docblocks.readers.container import Unreadable
from docblocks.readers.model import ERROR, PARAGRAPH_DDL, WARNING, Para, marked_all, record_batch
from docblocks.sources import encoding

# Messages (fixed values).
RETIRED = {
    ".rtf": "O formato .rtf não é mais aceito: salve o documento como .docx ou .odt.",
    ".doc": "O formato .doc não é aceito. Abra o arquivo no Word ou LibreOffice e salve como .docx ou .odt.",
}
LOCKED = "Não foi possível abrir {name}. O arquivo pode estar danificado ou protegido por senha. Abra no Word ou LibreOffice, retire a proteção se houver e salve uma nova cópia em .docx."
BAD_PDF = "Não foi possível ler {name}. O PDF pode estar danificado ou protegido. Abra o arquivo e exporte uma nova cópia em PDF antes de tentar novamente."
NEEDS_OCR = "O PDF {name} não tem camada de texto: provavelmente é um documento digitalizado e precisa de OCR."
OCR_EMPTY = "o OCR não reconheceu texto nas páginas. Confira se a digitalização está legível."
OCR_USED = (
    "**O texto foi reconhecido por OCR e pode ter erros.** Confira nomes, números, datas e valores com o original antes de salvar no SEI.",
    "**Muitos erros?** Peça o documento original em Word (.docx) ou use outro programa de OCR: [PDF24](https://tools.pdf24.org/pt/ocr-pdf) (online; o documento vai para o servidor do serviço), Adobe Acrobat ou ABBYY FineReader (instalados no computador).",
)
FAILED = "Não foi possível converter {name}: {detail}"
UNSUPPORTED = "Formato não suportado: '{suffix}'. Extensões aceitas: .docx, .htm, .html, .md, .odt, .pdf, .txt"
#: Rows of an Arrow batch that a reader yields.
ROWS = 2000


def _text(raw: bytes, markdown_file: bool) -> Iterator[Para]:
    text, _, warnings, error = encoding.decode(raw, markdown_file)
    if error:
        raise Unreadable("text", error)
    for message in warnings:
        yield Para(WARNING, message=message)
    yield from markdown.paragraphs(text or "", markdown_file)


def _page(raw: bytes, pasted: bool) -> Iterator[Para]:
    text, _, warnings, error = encoding.decode_html(raw)
    if error:
        raise Unreadable("text", error)
    for message in warnings:
        yield Para(WARNING, message=message)
    yield from html.paragraphs(text or "", pasted)


READERS: dict[str, Callable[[bytes, bool], Iterator[Para]]] = {
    ".docx": lambda raw, _: docx.paragraphs(raw),
    ".odt": lambda raw, _: odt.paragraphs(raw),
    ".md": lambda raw, _: _text(raw, True),
    ".txt": lambda raw, _: _text(raw, False),
    ".html": _page,
    ".htm": _page,
    ".pdf": lambda raw, _: pdf.paragraphs(raw),
}


def message(name: str, suffix: str, error: Exception) -> str:
    """What to tell the user of a file that can't be read."""
    kind = getattr(error, "kind", "")
    if suffix == ".docx" and kind == "container":
        return LOCKED.format(name=name)
    if kind == "pdf":
        return BAD_PDF.format(name=name)
    if kind == "no text layer":
        return FAILED.format(name=name, detail=NEEDS_OCR.format(name=name))
    return FAILED.format(name=name, detail=str(error) or type(error).__name__)


def _formatted(para: Para) -> Para:
    """A paragraph whose reader says nothing of bold and strike has what all of its runs have."""
    if para.bold is None:
        para.bold = marked_all(para.runs, "bold")
    if para.strike is None:
        para.strike = marked_all(para.runs, "strike")
    return para


def read_one(name: str, suffix: str, raw: bytes | None, recognised: str | None = None, pasted: bool = False) -> list[Para]:
    """Paragraphs of one file; ``recognised`` is text that OCR took from its pages."""
    suffix = (suffix or "").lower()
    try:
        if recognised is not None:
            if not recognised.strip():
                raise Unreadable("ocr", OCR_EMPTY)
            return [*[Para(WARNING, message=m) for m in OCR_USED], *map(_formatted, pdf.paragraphs_of_text(recognised))]
        if suffix in RETIRED or suffix not in READERS:
            raise Unreadable("format", RETIRED.get(suffix) or UNSUPPORTED.format(suffix=suffix))
        return [_formatted(p) for p in READERS[suffix](raw or b"", pasted)]
    except Exception as error:  # one bad file is one row, whatever is wrong with it
        return [Para(ERROR, message=message(name, suffix, error))]


def dealt(files: DataFrame) -> DataFrame:
    """``files`` dealt out evenly: readers take milliseconds a file, and a table of one row group would be read by one task."""
    spark = files.sparkSession
    return files.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))


def paragraphs(files: DataFrame, id_col: str = "doc_id", name_col: str = "name", suffix_col: str = "suffix", content_col: str = "content", recognised_col: str | None = None, pasted: bool = False) -> DataFrame:
    """(id, pos, and the fields of a paragraph) of every file; ids are told apart by the caller."""
    kind = files.schema[id_col].dataType.simpleString()
    columns = [id_col, name_col, suffix_col, content_col, *([recognised_col] if recognised_col else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[int, int, Para]] = []
            for i in range(batch.num_rows):
                name, suffix, raw = (batch.column(k)[i].as_py() for k in (1, 2, 3))
                said = batch.column(4)[i].as_py() if recognised_col else None
                rows += [(i, pos, para) for pos, para in enumerate(read_one(name or "", suffix, raw, said, pasted))]
                if len(rows) >= ROWS:
                    yield record_batch(id_col, batch.column(0), rows)
                    rows = []
            if rows:
                yield record_batch(id_col, batch.column(0), rows)

    return dealt(files.select(*columns)).mapInArrow(run, f"`{id_col}` {kind}, {PARAGRAPH_DDL}")
