"""What the queries must find, spelled out a second time for the SQL side.

The SQL never reads the lists of the code under test: changing a list there turns its query red."""

from __future__ import annotations

# Word lists, patterns and sites as published.
AUDIO = ['.mp3', '.wav', '.flac', '.m4a', '.ogg']
AUDIT_PATTERNS = [
    'All chats', 'retry', 'share', 'Claude can make mistakes', 'Research Sonnet 4', '@keyframes',
    'test message confirmation',
]
BUTTON_ENDINGS = ['^.*\\s+retry\\z', '^.*\\s+share\\z', '^test\\s+message\\s+confirmation']
BUTTON_TOKEN = '(?i)^(Write|Strategize|Create|Learn|From\\s+Drive|Publish|Share|Copy|Edit|Delete)\\z'
CHATGPT_LABELS = [
    '(?i)^(copy|regenerate|share|edit|retry)\\z', '(?i)^(thumbs up|thumbs down)\\z',
    '(?i)^(stop generating|continue|show more)\\z', '^\\d+/\\d+\\z', '(?i)^(new chat|clear chat)\\z',
    '(?i)^(like|dislike)\\z', '(?i)^(read aloud)\\z',
]
CHROME_CLASSES = ['header', 'nav', 'sidebar', 'toolbar']
CLAUDE_LABELS = [
    '(?i)\\w+\\s+(retry|share)\\z', '(?i)test message confirmation', '(?i)message confirmation',
    '(?i)^(yes|no|retry|share)\\z', '(?i)^Thinking', '(?i)^Gathering', '(?i)^ArtifactsArtifacts\\z',
    '(?i)^Artifacts\\z',
]
CONTENT_CLASSES = ['markdown', 'prose', 'text-token-text-primary']
CUT_KEYWORDS = ['VOLUME:', 'PLAY:', 'OVERLAY:', 'CAPTION:', 'PAUSE:', 'STOP:', 'STOP ALL:', 'SEQUENCE:']
ECHO_PHRASES = ['(?i)^You said:', '(?i)^ChatGPT said:\\s*You said:']
FEEDBACK = [
    '(?i)response do you prefer\\?', '(?i)which response do you prefer', "(?i)You're giving feedback on a new version",
    '(?i)ChatGPT Response \\d+', '(?i)Responses may take a moment to load',
]
GREETINGS = [
    "hi, i'm claude", "hello, i'm claude", "i'm claude", 'how can i help you today', 'what can i help you with today',
    'how may i assist you today', 'hi there! how can i help',
]
IMAGE = ['.jpg', '.jpeg', '.png', '.webp', '.bmp', '.gif']
KNOWN_SITES = ['youtube.com', 'youtu.be', 'github.com', 'archive.org', 'vimeo.com']
LABELS = [
    'all chats', 'new chat', 'retry', 'share', 'delete', 'claude can make mistakes', 'please double-check responses',
    'pending context request', 'artifacts', 'projects', 'claude code', 'starred', 'chats projects artifacts', 'recents',
    'test message confirmation share', 'test message confirmation', 'confirmation', 'message confirmation',
]
LABEL_PARTS = ['chats projects artifacts', 'claude can make mistakes', 'retry', 'confirmation share', 'message confirmation']
LABEL_WORDS = ['research', 'sonnet', 'writing', 'method', 'analysis', 'review', 'request']
LEAD_KEYWORDS = ['PLAY:', 'PAUSE', 'STOP', 'VOLUME:', 'OVERLAY:', 'SEQUENCE:']
LOST_DOTS = [
    ('wikimediaorg', 'wikimedia.org'), ('wikipediacommons', 'wikipedia/commons'),
    ('httpstatusdogscom', 'httpstatusdogs.com'), ('youtubecom', 'youtube.com'), ('wwwyoutube', 'www.youtube'),
]
LOST_PREFIXES = [
    ('httpswwwyoutubecom', 'https://www.youtube.com/'), ('httpyoutubecom', 'http://youtube.com/'),
    ('wwwyoutubecom', 'www.youtube.com/'), ('httpswww', 'https://www.'), ('httpwww', 'http://www.'),
    ('httpsgithubcom', 'https://github.com/'), ('httpgithubcom', 'http://github.com/'), ('httpscom', 'https://'),
    ('httpcom', 'http://'),
]
MEDIA_ENDINGS = ['.mp4', '.webm', '.mkv', '.mov', '.m4v', '.avi', '.mp3', '.wav', '.flac']
MEDIA_SITES = ['youtube.com', 'youtu.be', 'vimeo.com', 'archive.org']
MUSICAL_SETS = {
    'capture': ['PLAY:', 'STOP', 'VOLUME:'],
    'lab': ['PLAY:', 'SEQUENCE:', 'VOLUME:', 'PAUSE:', 'STOP:'],
    'repeat': ['PLAY:', 'SEQUENCE:', 'VOLUME:', 'PAUSE:', 'STOP:', 'NEXT:', 'PREV:'],
}
NAVIGATION_LINKS = [
    '^https://chatgpt\\.com/c/[a-f0-9-]+\\z', '^https://chatgpt\\.com/(library|gpts|codex)\\z',
    '^https://chatgpt\\.com/g/g-[a-zA-Z0-9-]+', '^https://chatgpt\\.com/(#main)?\\z', '^https://sora\\.chatgpt\\.com',
]
NUMBER = '\\d+(?:\\.\\d+)?'
PLACEHOLDER_URLS = ['<url', 'file://path', 'example.mp4', 'example.jpg', 'abc', 'def', 'filename.mp4', 'your_file']
PLATFORM_TOOLS = {
    'claude': ['thinking', 'computer_use', 'bash', 'python', 'code_execution'],
    'chatgpt': ['web_search', 'dall_e', 'code_interpreter', 'browser'],
}
SAMPLE_PHRASES = [
    'example.mp4', 'example.jpg', 'cheatsheet', 'format guide', 'syntax rules', 'use normalized values',
    'may be decimal', 'chain items with', 'file://path', 'you said:', 'chatgpt said:', 'user:', 'assistant:', 'example',
    'placeholder',
]
SONNET_PHRASES = ['how can i help', 'what would you like', 'feel free to']
STYLE_PARTS = [
    '@keyframes', 'position: fixed', 'z-index:', 'rgba(', 'transform:', 'animation:', 'box-shadow:', 'border-radius:',
    'opacity:', 'background:', '.intercom-', 'px;', 'rem;', 'vh;', 'vw;', '%;',
]
THINKING = [
    '(?i)^ChatGPT said:\\s*Thinking\\s*Skip?\\z', '(?i)^ChatGPT said:\\s*Thought for .* Skip?\\z',
    '(?i)^Thinking\\s*Skip?\\z', '(?i)^Thought for .* Skip?\\z',
]
TITLE_PARTS = ['research sonnet 4', 'j james', 'j test']
TOOL_MENTIONS = [
    '(?:used|using|calling)\\s+(\\w+)\\s+tool', '\\[Tool:\\s*(\\w+)\\]', '```(\\w+)\\s*\\n',
    '\\*\\*Tool Used:\\*\\*\\s*(\\w+)', 'tool_calls?[\\"\']?:\\s*[\\"\']?(\\w+)',
]
VIDEO = ['.mp4', '.webm', '.mkv', '.mov', '.m4v', '.avi']
WHOLE_ENDINGS = ['.jpg', '.png', '.gif', '.webp', '.mp4', '.webm']
WRAPPER_PHRASES = ['said:', 'chatgpt', 'user', 'conversation']
