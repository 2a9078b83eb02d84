"""Keys that make no edge, and descriptions of node types."""

from __future__ import annotations

#: Keys of an object that are not emitted as attribute edges.
SKIPPED_KEYS = [
    "x_mitre_modified_by_ref", "modified_by_ref", "x_mitre_contents", "id", "source_ref", "target_ref", "object_ref",
    "relationship_type", "x_mitre_version", "x_mitre_attack_spec_version", "created_by_ref", "object_marking_refs",
]

#: What the starting point says about a node type.
GLOSSARY = {
    "x_mitre_detection": "Strategies for identifying if a technique has been used by an adversary.",
    "x_mitre_platforms": "List of platforms that apply to the technique.",
    "x_mitre_data_sources": "Sources of information that may be used to identify the action or result of the action being performed.",
    "x_mitre_is_subtechnique": "If true, this attack-pattern is a sub-technique.",
    "x_mitre_system_requirements": "Additional information on requirements the adversary needs to meet or about the state of the system (software, patch level, etc.) that may be required for the technique to work.",
    "x_mitre_tactic_type": "Post-Adversary Device Access, Pre-Adversary Device Access, or Without Adversary Device Access.",
    "x_mitre_permissions_required": "The lowest level of permissions the adversary is required to be operating within to perform the technique on a system.",
    "x_mitre_effective_permissions": "The level of permissions the adversary will attain by performing the technique.",
    "x_mitre_defense_bypassed": "List of defensive tools, methodologies, or processes the technique can bypass.",
    "x_mitre_remote_support": "If true, the technique can be used to execute something on a remote system.",
    "x_mitre_impact_type": "Denotes if the technique can be used for integrity or availability attacks.",
    "x_mitre_aliases": "List of aliases for the given software.",
    "x_mitre_first_seen_citation": "One to many citations for when the Campaign was first reported.",
    "x_mitre_last_seen_citation": "One to many citations for when the Campaign was last reported.",
    "x_mitre_sectors": "List of industry sector(s) an asset may be commonly observed in.",
    "x_mitre_related_assets": "Sector-specific device names or aliases commonly associated with the asset.",
    "attack_pattern": "Attack Patterns describe ways adversaries attempt to compromise targets.",
    "course_of_action": "Actions to prevent or respond to an attack in progress.",
    "malware": "Malicious code/software.",
    "tool": "Legitimate software used by threat actors.",
    "campaign": "Grouping of adversarial behaviors over time against specific targets.",
    "intrusion_set": "Grouped adversarial behaviors/resources believed orchestrated by a single org.",
}

#: Terms that a paraphrase must neither add nor lose.
MALWARE_TERMS = ["ransomware", "spyware", "backdoor", "worm", "trojan", "rat", "in-memory", "steal", "spy"]

DESCRIPTION = "description"
EDGE_SCHEMA = "src string, dst string, label string, pos long"
EMPTY_LIST = "Not Available"
