"""quillgrove.plans"""
