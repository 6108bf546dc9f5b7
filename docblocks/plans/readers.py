"""Queries of the readers and of the whole conversion."""

from __future__ import annotations

from pyspark.sql import functions as F

from docblocks import pipeline, sinks
from docblocks.plans.registry import query, table
from docblocks.readers import read
from docblocks.sources import encoding, html


def page_files(spark, sf, before: str = ""):
    """Pages as HTML files, with something put before their markup."""
    content = F.concat(F.lit(before), "html").cast("binary")
    return table(spark, sf, "pages").select("page_id", F.concat(F.lit("page"), F.col("page_id").cast("string"), F.lit(".html")).alias("name"), F.lit(".html").alias("suffix"), content.alias("content"))


def document_files(spark, sf):
    """Documents as Markdown (even ids) and plain text files."""
    suffix = F.when(F.col("doc_id") % 2 == 0, ".md").otherwise(".txt")
    return table(spark, sf, "documents").select("doc_id", F.concat(F.lit("doc"), F.col("doc_id").cast("string"), suffix).alias("name"), suffix.alias("suffix"), F.col("text").cast("binary").alias("content"))


@query("page_nodes")
def q_nodes(spark, sf):
    return html.nodes(table(spark, sf, "pages"), "page_id", "html").select("page_id", "node_id", "parent_id", "seq", "depth", "tag", "text")


@query("page_paragraphs")
def q_paragraphs(spark, sf):
    found = pipeline.judged(pipeline.prepared(read.paragraphs(page_files(spark, sf), "page_id"), "page_id"), "page_id")
    return pipeline.classed(found, pipeline.Options()).select("page_id", "pos", "kind", "class", "text")


@query("page_runs")
def q_runs(spark, sf):
    texts = html.nodes(table(spark, sf, "pages"), "page_id", "html").where("tag = '#text'")
    return html.merged_runs(texts, "page_id", "node_id", ["bold", "italic", "strike", "underline"])


@query("page_tags", r"""SELECT page_id, len(regexp_extract_all(html, '(?i)<h1[ >]')) AS h1, len(regexp_extract_all(html, '(?i)<li[ >]')) AS li, len(regexp_extract_all(html, '(?i)<a[ >]')) AS a FROM pages""")
def q_tags(spark, sf):
    count = lambda tag: F.count_if(F.col("tag") == tag).alias(tag)
    return html.nodes(table(spark, sf, "pages"), "page_id", "html").groupBy("page_id").agg(count("h1"), count("li"), count("a"))


@query("declared_charset", r"""SELECT page_id, coalesce(lower(regexp_extract(list_filter(regexp_extract_all(substr(html, 1, 4096), '(?is)<meta\b[^>]*>'), lambda t: regexp_matches(t, '(?i)\bcharset\s*='))[1], '(?i)\bcharset\s*=[\s"'']*([A-Za-z0-9_.:-]+)', 1)), '') AS charset FROM pages""")
def q_charset(spark, sf):
    return table(spark, sf, "pages").select("page_id", encoding.declared_charset(F.col("html")).alias("charset"))


@query("decoded_pages", "SELECT page_id, html AS text FROM pages")
def q_decoded(spark, sf):
    """Pages written in three encodings, as their characters and ids allow, read back as plain text."""
    western = F.col("html").rlike("^[\\x00-\\x7F\\u00A0-\\u00FF]*$")
    raw = F.when(F.col("page_id") % 3 == 1, F.encode("html", "UTF-16")).when((F.col("page_id") % 3 == 2) & western, F.encode("html", "ISO-8859-1")).otherwise(F.col("html").cast("binary"))
    return table(spark, sf, "pages").select("page_id", encoding.decoded(raw)["text"].alias("text"))


@query("page_warnings", """SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'A assinatura eletrônica e a nota de autenticidade do SEI foram retiradas: o SEI as gera de novo no documento novo.' END AS platform,
 CASE WHEN regexp_matches(html, '(?i)<img[ >]') OR page_id % 3 = 0 THEN 'Imagens do HTML não foram incorporadas. Insira-as no SEI após conferir o original.' END AS images FROM pages""")
def q_page_warnings(spark, sf):
    """What the reader says of pages with a platform's note (every other page) or an image (every third, and those that have one)."""
    extra = F.concat(F.when(F.col("page_id") % 2 == 0, "<div><p>Documento assinado eletronicamente por A. B., em 2024.</p></div>").otherwise(""), F.when(F.col("page_id") % 3 == 0, '<p>x<img src="a.png"></p>').otherwise(""))
    files = page_files(spark, sf).withColumn("content", F.concat(extra.cast("binary"), "content"))
    said = read.paragraphs(files, "page_id").where("kind = 'warning'").select("page_id", "message")
    has = lambda start: F.max(F.when(F.col("message").startswith(start), F.col("message")))
    found = said.groupBy("page_id").agg(has("A assinatura").alias("platform"), has("Imagens").alias("images"))
    return table(spark, sf, "pages").select("page_id").join(found, "page_id", "left")


@query("page_producers", r"""SELECT page_id, CASE WHEN regexp_matches(html, '(?i)(urn:schemas-microsoft-com:office|class="?Mso|<meta[^>]+Microsoft Word)') THEN 'word' WHEN regexp_matches(html, '(?i)<body[^>]+class="[^"]*\bdoc-content\b') THEN 'google' END AS producer FROM pages""")
def q_producers(spark, sf):
    return table(spark, sf, "pages").select("page_id", html.producer(F.col("html")).alias("producer"))


@query("converted_documents")
def q_documents(spark, sf):
    """Every document through the whole conversion: Markdown and plain text files to pages."""
    found = pipeline.convert(document_files(spark, sf), pipeline.Options(body_only=True))
    return found.select("doc_id", "sucesso", F.array_join("avisos", " | ").alias("avisos"), F.get("arquivos", F.lit(0))["nome"].alias("nome"), F.get("arquivos", F.lit(0))["conteudo"].alias("html"), "cabecalho_paragrafos", "citacoes_entre_aspas")


@query("converted_pages")
def q_pages(spark, sf):
    found = pipeline.convert(page_files(spark, sf), pipeline.Options(), id_col="page_id")
    return found.select("page_id", "sucesso", F.array_join("avisos", " | ").alias("avisos"), F.get("arquivos", F.lit(0))["nome"].alias("nome"), F.get("arquivos", F.lit(0))["conteudo"].alias("html"))


_BROKEN = "CASE page_id % 6 WHEN 0 THEN '.doc' WHEN 1 THEN '.docx' WHEN 2 THEN '.pdf' WHEN 3 THEN '.xlsx' WHEN 4 THEN '.odt' ELSE '.md' END"


@query("error_messages", f"""SELECT page_id, s = '.md' AS sucesso, CASE s WHEN '.doc' THEN 'Não foi possível converter ' || n || ': O formato .doc não é aceito. Abra o arquivo no Word ou LibreOffice e salve como .docx ou .odt.'
 WHEN '.docx' THEN 'Não foi possível abrir ' || n || '. O arquivo pode estar danificado ou protegido por senha. Abra no Word ou LibreOffice, retire a proteção se houver e salve uma nova cópia em .docx.'
 WHEN '.pdf' THEN 'Não foi possível ler ' || n || '. O PDF pode estar danificado ou protegido. Abra o arquivo e exporte uma nova cópia em PDF antes de tentar novamente.'
 WHEN '.xlsx' THEN 'Não foi possível converter ' || n || ': Formato não suportado: ''.xlsx''. Extensões aceitas: .docx, .htm, .html, .md, .odt, .pdf, .txt'
 WHEN '.odt' THEN 'Não foi possível converter ' || n || ': BadZipFile: File is not a zip file' ELSE '' END AS erros FROM (SELECT page_id, 'arquivo' || page_id || s AS n, s FROM (SELECT page_id, {_BROKEN} AS s FROM pages) a) b""")
def q_errors(spark, sf):
    """Pages under suffixes that don't fit them: an error row each, and no failed task."""
    suffix = F.expr(_BROKEN)
    files = table(spark, sf, "pages").select("page_id", F.concat(F.lit("arquivo"), F.col("page_id").cast("string"), suffix).alias("name"), suffix.alias("suffix"), F.concat(F.lit("texto "), "html").cast("binary").alias("content"))
    return pipeline.convert(files, id_col="page_id").select("page_id", "sucesso", F.array_join("erros", " | ").alias("erros"))


@query("conversion_report", "SELECT count(*) AS documents, count(*) FILTER (page_id % 6 = 5) AS converted, count(*) FILTER (page_id % 6 <> 5) AS failed, 1 AS exit_status FROM pages")
def q_report(spark, sf):
    suffix = F.expr(_BROKEN)
    files = table(spark, sf, "pages").select("page_id", F.lit("a").alias("name"), suffix.alias("suffix"), F.lit("texto").cast("binary").alias("content"))
    return sinks.report(pipeline.convert(files, id_col="page_id")).select("documents", "converted", "failed", "exit_status")
