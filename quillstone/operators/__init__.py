"""quillstone.operators"""
