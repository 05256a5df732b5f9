"""quillgrove.operators"""
