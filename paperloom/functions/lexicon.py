"""Word lists and lookup tables whose values are fixed by the data they classify."""

from __future__ import annotations

# Topics with the substrings that vote for them, in priority order.
TOPIC_KEYWORDS: dict[str, list[str]] = {
    "llm_pretraining": [
        "pretraining", "pre-training", "pre-trained", "foundation model", "scaling", "large language model", "llm training",
    ],
    "reasoning_alignment": [
        "reasoning", "chain-of-thought", "cot", "alignment", "rlhf", "reinforcement learning from human feedback", "safety",
    ],
    "multimodal": ["multimodal", "vision-language", "vlm", "image-text", "visual question answering", "vqa"],
    "retrieval_rag": [
        "retrieval", "rag", "retrieval-augmented", "knowledge base", "information retrieval", "dense retrieval",
    ],
    "architecture": ["transformer", "attention", "architecture", "moe", "mixture of experts", "sparse", "efficient"],
    "optimization": [
        "quantization", "pruning", "distillation", "compression", "efficient", "lora", "peft", "fine-tuning",
    ],
    "evaluation": ["benchmark", "evaluation", "metric", "leaderboard", "assessment", "capability"],
}

# Share of a sample each topic should get.
TARGET_SHARES: dict[str, float] = {
    "llm_pretraining": 0.20,
    "reasoning_alignment": 0.20,
    "multimodal": 0.15,
    "retrieval_rag": 0.15,
    "architecture": 0.10,
    "optimization": 0.10,
    "evaluation": 0.10,
}

# Phrases that drop a paper in the rule-based split.
NEGATIVE_PHRASES: list[str] = [
    "Robot", "Robotics", "Game", "Gaming", "Image Classification", "Object Detection", "Speech Recognition",
    "MRI", "CT scan", "Ultrasound", "Brain Tumor Segmentation", "Retinal Imaging", "Medical Image Segmentation",
    "Radiology", "Cardiac Segmentation", "Glioma Segmentation",
    "EEG", "ECG", "Radar Signal", "Speech Emotion Recognition", "Audio Source Separation", "Sleep Staging",
    "Vortex-Induced Vibration",
    "LiDAR", "Point Cloud", "Depth Estimation", "3D Reconstruction", "Pose Estimation", "Image Segmentation",
    "Semantic Segmentation",
    "UAV", "Unmanned Aerial Vehicle", "Trajectory Prediction", "Autonomous Vehicle", "Path Planning",
    "Multi-Agent Pathfinding", "Motion Planning",
    "Policy Learning", "Markov Decision Process", "MDP", "Reward Shaping", "Q-Learning",
    "Multi-Agent Reinforcement Learning", "MARL",
    "Node Classification", "Community Detection", "Graph Clustering",
    "Time Series Forecasting", "Traffic Prediction", "Sensor Data", "Precipitation Forecasting", "Weather Forecasting",
    "Archaeology", "Aviation Safety", "Molecular Generation", "Chemical Structure", "Marine Riser", "Tyre Energy",
    "Formula One",
    "Latent Dirichlet Allocation", "LDA Topic Model", "Lemmatization", "Word Sense Disambiguation",
    "Hierarchical Clustering",
    "Federated Learning", "Outlier Detection", "Anomaly Detection", "Malware Detection",
    "Traffic Signal Control", "Maritime", "Ship Identification", "Furnace", "Vehicle Detection",
]

# Phrases that keep a paper without a second look.
STRONG_INDICATORS: list[str] = [
    "language model", "llm", "large language", "gpt", "chatgpt", "llama", "instruction tuning", "rlhf", "prompt",
    "in-context learning",
    "transformer architecture", "self-attention mechanism", "mixture-of-experts", "mixture of experts", "moe model",
    "model compression", "knowledge distillation", "model pruning", "ai-generated text", "machine-generated text",
    "text detection", "retrieval-augmented generation", "retrieval augmented", "rag", "foundation model",
    "pre-trained model", "pretrained model", "fine-tuning", "fine tuning", "model merging", "task vector",
    "task arithmetic", "test-time compute", "generative ai", "genai", "text generation", "natural language generation",
    "nlg", "bert", "t5", "bart",
    "slot and intent detection", "natural language understanding", "nlu", "text classification", "sentiment analysis",
    "named entity recognition", "ner", "question answering", "machine translation", "neural machine translation", "nmt",
]

# Keyword-file headings and the category each belongs to, first match wins.
CATEGORY_HEADINGS: dict[str, str] = {
    "biomedical / bioinformatics / healthcare": "biomedical",
    "biomedical": "biomedical",
    "chemistry / material science / physics simulation": "chemistry_materials",
    "chemistry": "chemistry_materials",
    "earth science / climate / remote sensing / geoscience": "earth_science",
    "earth science": "earth_science",
    "robotics / control / signal processing": "robotics_control",
    "robotics": "robotics_control",
    "finance / economics / social science": "finance_social",
    "finance": "finance_social",
    "domain-specific computer vision": "domain_cv",
    "domain specific computer vision": "domain_cv",
    "education / psychology / cognitive science": "education_psychology",
    "education": "education_psychology",
    "low-level hardware / systems": "hardware_systems",
    "hardware": "hardware_systems",
}

# Titles (after numbering is stripped) of sections left out of the index.
EXCLUDED_TITLES: list[str] = [
    "references?", "bibliography", "citations?", r"works?\s+cited",
    "acknowledgm?ents?", "acknowledgements?",
    r"author\s+contributions?", "contributions?", r"author\s+information", "authors?",
    r"ethics\s+statement", r"ethical\s+considerations?", r"broader\s+impact", r"societal\s+impact",
    "funding", r"funding\s+statement", r"financial\s+support", r"competing\s+interests?", r"conflict\s+of\s+interest",
    r"declaration\s+of\s+interests?", "disclosures?",
    r"supplementary\s+materials?", r"supplemental\s+materials?", "appendix", "appendices",
    r"data\s+availability", r"code\s+availability", "reproducibility",
]

# Weight of a section by its normalised title; anything else weighs 0.7.
SECTION_WEIGHTS: dict[str, float] = {
    "abstract": 1.0, "introduction": 0.9, "method": 0.85, "methodology": 0.85, "methods": 0.85, "approach": 0.85,
    "model": 0.85, "architecture": 0.85, "experiments": 0.8, "experimental setup": 0.75, "results": 0.85,
    "evaluation": 0.8, "analysis": 0.8, "discussion": 0.75, "conclusion": 0.7, "conclusions": 0.7, "related work": 0.6,
    "background": 0.65, "preliminaries": 0.6, "limitations": 0.7, "future work": 0.5,
}
DEFAULT_SECTION_WEIGHT = 0.7

# Own choice: words a full-text query ignores.
STOP_WORDS: list[str] = [
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not", "of",
    "on", "or", "such", "that", "the", "their", "then", "there", "these", "they", "this", "to", "was", "will", "with",
]
