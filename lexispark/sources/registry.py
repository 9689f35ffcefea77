"""Datasets: files, positional columns, indexed fields, and the field that ranks exact and prefix matches.

All source columns are strings; a column that a short row lacks is NULL, an empty one is ''.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


@dataclass(frozen=True)
class Dataset:
    name: str
    file: str | None
    columns: tuple[str, ...]
    indexed: tuple[str, ...]
    primary: str
    enabled: bool = True

    @property
    def schema(self) -> T.StructType:
        fields = [T.StructField(c, T.LongType() if c == "medicaments_count" else T.StringType()) for c in self.columns]
        return T.StructType([T.StructField("_pos", T.LongType()), *fields])


# The registry's file layout: name, file, columns in order, indexed fields, ranking field.
_LAYOUT = (
    ("specialites", "CIS_bdpm.txt", ("cis", "denomination", "forme_pharma", "voies_admin", "statut_amm", "type_amm", "commercialisation", "date_amm", "statut_bdm", "num_autorisation_euro", "titulaire", "surveillance_renforcee"), ("cis", "denomination", "forme_pharma", "titulaire"), "denomination"),
    ("presentations", "CIS_CIP_bdpm.txt", ("cis", "cip7", "libelle", "statut_admin", "etat_commercialisation", "date_declaration", "cip13", "agrement_collectivite", "taux_remboursement", "prix_medicament", "prix_public", "honoraires", "indications"), ("cis", "cip7", "cip13", "libelle", "indications"), "libelle"),
    ("compositions", "CIS_COMPO_bdpm.txt", ("cis", "designation_element", "code_substance", "denomination_substance", "dosage", "reference_dosage", "nature_composant", "numero_ordre"), ("cis", "denomination_substance", "dosage"), "denomination_substance"),
    ("avis_smr", "CIS_HAS_SMR_bdpm.txt", ("cis", "has_dossier", "motif_evaluation", "date_avis", "valeur_smr", "libelle_smr"), ("libelle_smr", "valeur_smr"), "libelle_smr"),
    ("avis_asmr", "CIS_HAS_ASMR_bdpm.txt", ("cis", "has_dossier", "motif_evaluation", "date_avis", "valeur_asmr", "libelle_asmr"), ("libelle_asmr", "valeur_asmr"), "libelle_asmr"),
    ("generiques", "CIS_GENER_bdpm.txt", ("id_groupe", "libelle_groupe", "cis", "type_generique", "numero_ordre"), ("libelle_groupe",), "libelle_groupe"),
    ("conditions", "CIS_CPD_bdpm.txt", ("cis", "condition"), ("condition",), "condition"),
    ("ruptures", "CIS_CIP_Dispo_Spec.txt", ("cis", "cip13", "code_statut", "libelle_statut", "date_debut", "date_mise_a_jour", "date_remise_dispo", "lien_ansm"), ("libelle_statut",), "libelle_statut"),
    ("mitm", "CIS_MITM.txt", ("cis", "code_atc", "denomination", "lien_fi"), ("cis", "code_atc", "denomination"), "denomination"),
    ("infos", "CIS_InfoImportantes.txt", ("cis", "date_debut", "date_fin", "texte_affichage"), ("cis", "texte_affichage"), "texte_affichage"),
    ("substances", None, ("code", "denomination", "medicaments_count"), ("denomination",), "denomination"),
)

DATASETS = {name: Dataset(name, file, columns, indexed, primary, name != "infos") for name, file, columns, indexed, primary in _LAYOUT}
