"""Preparation of training data: packing, blending, sampling, chats, masks, retrieval sets."""
