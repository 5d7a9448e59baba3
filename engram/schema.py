"""Table layouts."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _I, _D = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType()
_TS, _LIST = T.TimestampType(), T.ArrayType(T.StringType())


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


SEGMENTS = _struct(
    id=_L, timestamp=_TS, timestamp_epoch=_L, token_start=_I, token_end=_I, source_file=_S, source_nature=_S,
    source_format=_S, source_origine=_S, auteur=_S, emotion_valence=_D, emotion_activation=_D, tags_roget=_LIST,
    personnes=_LIST, projets=_LIST, sujets=_LIST, lieux=_LIST, organisations=_LIST, resume_texte=_S, gr_id=_L,
    pilier=_I, vecteur=T.MapType(_I, _D), poids_mnemique=_D, ego_version=_S, modele=_S, date_creation=_TS,
    confidence_score=_D, statut_verite=_I,
)
# columns only the first schema version had
SEGMENTS_V1_EXTRA = _struct(
    type_contenu=_S, cognition_certitude=_D, cognition_complexite=_D, cognition_abstraction=_D, physique_energie=_D,
    physique_stress=_D, comm_clarte=_D, comm_formalite=_D, resume_mots_cles=_S, climat_session=_S,
)
EDGES = _struct(source_id=_L, target_id=_L, type=_S, poids=_D, metadata=T.MapType(_S, _S))
PILLARS = _struct(id=_L, fait=_S, categorie=_S, importance=_I, source_id=_L, date_creation=_TS)
PERSONS = _struct(id=_L, nom_canonique=_S, variantes=_LIST, contexte=_S, domaine=_S, actif=_I)
PROJECTS = _struct(id=_L, nom=_S, parent_id=_L, description=_S, actif=_I)
CANDIDATES = _struct(kind=_S, nom=_S, contexte=_S, date_detection=_TS, n_mentions=_L)
CHUNKS = _struct(
    id=_L, doc_id=_S, filename=_S, source_uri=_S, source_type=_S, mime_type=_S, file_size=_L, date_modified=_TS,
    indexed_at=_TS, chunk_id=_S, chunk_index=_I, section_title=_S, page_start=_I, page_end=_I, content=_S,
    content_tokens=_I, roget_primary=_S, roget_codes=_LIST, summary=_S, keywords=_LIST, domain=_S, project=_S,
    indexation_status=_S,
)
FILES = _struct(
    id=_L, file_id=_S, path_lower=_S, path_display=_S, name=_S, extension=_S, size=_L, server_modified=_TS,
    content_hash=_S, domain=_S, summary=_S, keywords=_S, roget_codes=_S, importance=_I, status=_S, error_message=_S,
    enriched_at=_TS,
)
RESEARCH = _struct(file_path=_S, file_hash=_S, file_type=_S, title=_S, summary=_S, entities=_S, embedding=T.ArrayType(T.FloatType()))
FACTS = _struct(
    id=_L, domaine=_S, sujet=_S, information=_S, importance=_I, metadata=_S, date_creation=_TS, derniere_maj=_TS,
)

_TREE_MESSAGE = T.StructType([
    T.StructField("author", _struct(role=_S)),
    T.StructField("create_time", _D),
    T.StructField("content", T.StructType([
        T.StructField("content_type", _S), T.StructField("parts", _LIST), T.StructField("text", _S),
    ])),
    T.StructField("metadata", _struct(is_visually_hidden_from_conversation=T.BooleanType())),
])
TREE_EXPORT = T.StructType([
    T.StructField("title", _S),
    T.StructField("create_time", _D),
    T.StructField("mapping", T.MapType(_S, T.StructType([
        T.StructField("parent", _S), T.StructField("children", _LIST), T.StructField("message", _TREE_MESSAGE),
    ]))),
])
FLAT_EXPORT = T.StructType([
    T.StructField("uuid", _S), T.StructField("name", _S), T.StructField("summary", _S),
    T.StructField("created_at", _S), T.StructField("updated_at", _S),
    T.StructField("chat_messages", T.ArrayType(T.StructType([
        T.StructField("uuid", _S), T.StructField("sender", _S), T.StructField("created_at", _S), T.StructField("text", _S),
        T.StructField("content", T.ArrayType(_struct(type=_S, text=_S))),
    ]))),
])
