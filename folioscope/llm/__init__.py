"""Training-data operators: token counts, decontamination, joins on shingle sets,
URL rules, vector near-duplicates, language, licences, toxicity, chats and BPE.

Nothing outside this subpackage imports it.
"""
